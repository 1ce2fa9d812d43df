"""Vector arithmetic as columns. Vectors are arrays; arithmetic is done in double precision.

The running total of ``aggregate`` is handed to its finish function, so a norm is computed once per row and not
once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once even where ``body`` uses it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(vec: Column | str) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equally long vectors."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(vec: Column | str) -> Column:
    return F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vec: Column | str) -> Column:
    return F.sqrt(squared_norm(vec))


def l2_normalize(vec: Column | str, eps: float = 0.0) -> Column:
    """Unit vector. ``eps`` = 0 leaves the zero vector unchanged, otherwise divides by ``norm + eps``."""
    v = as_double(vec)

    def scale(total: Column) -> Column:
        divisor = F.sqrt(total) + F.lit(eps) if eps else F.when(total > 0, F.sqrt(total)).otherwise(F.lit(1.0))
        return F.transform(v, lambda x: x / divisor)

    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x, scale)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def two_prompt_vector(plain: Column | str, phrased: Column | str) -> Column:
    """Query vector of a text blended with its "a photo of ..." form."""
    return l2_normalize(add(plain, phrased), eps=1e-9)


def softmax(values: Column | str, scale: float = 1.0) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    v = as_double(values)

    def weigh(top: Column) -> Column:
        weights = F.transform(v, lambda x: F.exp(F.lit(scale) * (x - top)))
        return F.aggregate(
            weights, F.lit(0.0), lambda acc, e: acc + e, lambda total: F.transform(weights, lambda e: e / total)
        )

    return let(F.array_max(v), weigh)


def smooth_max(values: Column | str, tau: float = 0.02) -> Column:
    """``tau * ln(mean(exp((x - max) / tau))) + max`` of an array column."""
    v = as_double(values)

    def pool(top: Column) -> Column:
        return F.aggregate(
            v,
            F.lit(0.0),
            lambda acc, x: acc + F.exp((x - top) / F.lit(tau)),
            lambda total: F.lit(tau) * F.log(total / F.size(v)) + top,
        )

    return let(F.array_max(v), pool)


def histogram_correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of two histograms; 1.0 when both are constant."""
    x, y = as_double(a), as_double(b)
    n = F.size(x).cast("double")

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)

    covariance = dot(x, y) - total(x) * total(y) / n
    spread_x = squared_norm(x) - total(x) * total(x) / n
    spread_y = squared_norm(y) - total(y) * total(y) / n
    return F.when((spread_x <= 0) | (spread_y <= 0), F.lit(1.0)).otherwise(
        covariance / F.sqrt(spread_x * spread_y)
    )


# Bodies of the SQL forms; DOUBLE arrays in, DOUBLE or ARRAY<DOUBLE> out.
SQL_FUNCTIONS = {
    "l2_normalize": (
        "v ARRAY<DOUBLE>",
        "ARRAY<DOUBLE>",
        "aggregate(v, 0D, (s, x) -> s + x * x, s -> transform(v, x -> x / if(s > 0, sqrt(s), 1D)))",
    ),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D),"
        " if(a IS NULL OR b IS NULL, NULL, 0D))",
    ),
    # The maximum is bound by a list of one, so that it is found once.
    "softmax": (
        "v ARRAY<DOUBLE>, scale DOUBLE DEFAULT 1D",
        "ARRAY<DOUBLE>",
        "element_at(transform(array(array_max(v)), m -> aggregate(v, 0D, (s, x) -> s + exp(scale * (x - m)),"
        " s -> transform(v, x -> exp(scale * (x - m)) / s))), 1)",
    ),
    "smooth_max": (
        "v ARRAY<DOUBLE>, tau DOUBLE DEFAULT 0.02D",
        "DOUBLE",
        "element_at(transform(array(array_max(v)), m -> aggregate(v, 0D, (s, x) -> s + exp((x - m) / tau),"
        " s -> tau * ln(s / size(v)) + m)), 1)",
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Make the vector functions callable from ``spark.sql``."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
