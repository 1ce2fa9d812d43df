"""Vector aggregates per group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.vectors import as_double, l2_normalize


def pool_vectors(
    df: DataFrame, keys: list[str], vec: str = "embedding", how: str = "avg", normalise: bool = True, eps: float = 0.0
) -> DataFrame:
    """Mean (or sum) vector per group, by default scaled to unit length; null vectors don't count.

    The aggregate keeps one vector per group and task and merges them after the shuffle, so a task sends one row per
    group however many rows it holds; no group is collected.
    """
    combine = {"avg": Summarizer.mean, "sum": Summarizer.sum}[how]
    rows = df.filter(F.size(vec) > 0).select(*keys, array_to_vector(as_double(vec)).alias("_vector"))
    pooled = rows.groupBy(*keys).agg(vector_to_array(combine(F.col("_vector"))).alias("_pooled"))
    return pooled.select(*keys, (l2_normalize("_pooled", eps) if normalise else F.col("_pooled")).alias(vec))
