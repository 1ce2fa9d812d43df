"""Embedding whitening from exact squares: variances of dimensions and of their sums give every covariance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import saved

SCALE, SHIFT = 1024, 100000  # a number c counts as floor(SCALE * c) + SHIFT
COMPONENTS = 8
ROWS = 4096  # vectors that a task takes at once
LONG = (1 << 63) - 1
LOW = 60  # bits in the lower half of an exact sum
MOST_SUMS = 1 << 22  # sums of all widths together that the driver takes (one width of 2895); beyond that there is no fit

SUMS = "width int, i int, j int, n long, hi decimal(38,0), lo decimal(38,0)"


def finite(vec: str):
    """Vectors that are not null and hold finite numbers only."""
    v = F.col(vec)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def grid(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as longs; what a long cannot hold counts as the nearest that it can."""
    most = float(LONG - (1 << 20))
    return np.clip(np.floor(SCALE * np.clip(c, -most, most)), -most, most).astype(np.int64) + SHIFT


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is where ``bound`` shows that a long holds all that is made of it, else as Python numbers."""
    return x if bound <= LONG else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(width, rows, their grid values as a matrix) in parts of at most ROWS vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            widths = part.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                rows = part if (widths == w).all() else part.take(pa.array(np.flatnonzero(widths == w)))
                yield w, rows, grid(rows.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, w))


def _sum_rows(held: dict) -> Iterator[pa.RecordBatch]:
    """A row for each kept sum, in two halves, so that no number of rows is too many."""
    for width, (n, places, totals) in held.items():
        i, j = places
        hi = pa.array([Decimal(int(t) >> LOW) for t in totals], pa.decimal128(38, 0))
        lo = pa.array([Decimal(int(t) & (1 << LOW) - 1) for t in totals], pa.decimal128(38, 0))
        size = len(totals)
        yield pa.record_batch(
            [pa.array([width] * size, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * size, pa.int64()), hi, lo],
            names=["width", "i", "j", "n", "hi", "lo"],
        )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for w, _, x in _by_width(batches):
        n, places, total = held.get(w, (0, (np.arange(w), np.arange(w)), np.zeros(w, object)))
        held[w] = (n + len(x), places, total + exact(x, largest(x) * len(x)).sum(0).astype(object))
    yield from _sum_rows(held)


def squares(y: np.ndarray) -> np.ndarray:
    """Exact sums over rows: the square of each dimension on the diagonal, of each sum of two dimensions above it."""
    y = exact(y, 4 * largest(y) ** 2 * len(y))
    width = y.shape[1]
    out = np.zeros((width, width), object)
    for d in range(width):
        both = y[:, d:] + y[:, d : d + 1]
        both[:, 0] = y[:, d]
        out[d, d:] = (both * both).sum(0).astype(object)
    return out


def _squares(centres: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for w, _, x in _by_width(batches):
            n, total = held.get(w, (0, np.zeros((w, w), object)))
            held[w] = (n + len(x), total + squares(_less(x, np.array(centres[w], np.int64))))
        upper = {w: np.triu_indices(w) for w in held}
        yield from _sum_rows({w: (n, upper[w], total[upper[w]]) for w, (n, total) in held.items()})

    return run


def _less(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return exact(x, largest(x) + largest(centre)) - centre


def _collected(sums: DataFrame) -> dict[int, tuple[int, dict[tuple[int, int], int]]]:
    """By width how many rows there are and the exact sums: a number for each dimension or pair, however many the rows."""
    most = sums.select("width").distinct().agg(F.sum(F.col("width") * (F.col("width") + 1) / 2)).first()[0] or 0
    if most > MOST_SUMS:
        raise ValueError(f"{most} covariances over all widths; at most {MOST_SUMS} are fitted")
    total = sums.groupBy("width", "i", "j").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    out: dict = {}
    for batch in total.toArrow().to_batches():
        for width, i, j, n, hi, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(width, (n, {}))[1][i, j] = (int(hi) << LOW) + int(lo)
    return out


class Fit:
    """Mean, eigenvectors and eigenvalues for vectors of one width.

    ``y`` are values less the whole part of their mean, ``rest`` is what is left of n times the mean, so n times a
    centred value is n * y - rest, a whole number. Sums of squares about the mean follow from those about the centre in
    whole numbers, and so do covariances: V(a + b) - V(a) - V(b) is twice the covariance of a and b.
    """

    def __init__(self, n: int, totals: list[int], square: dict[tuple[int, int], int], components: int):
        self.n, width = n, len(totals)
        self.centre = [s // n for s in totals]
        self.rest = [s - n * c for s, c in zip(totals, self.centre, strict=True)]
        rest = self.rest
        own = [n * square[d, d] - rest[d] ** 2 for d in range(width)]
        v = np.zeros((width, width))
        for a in range(width):
            v[a, a] = own[a] / n**2
            for b in range(a + 1, width):
                v[a, b] = v[b, a] = (n * square[a, b] - (rest[a] + rest[b]) ** 2 - own[a] - own[b]) / (2 * n**2)
        self.covariance = v
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        values, trace = values[order], float(np.trace(v))
        real = values > np.finfo(float).eps * width * max(trace, 0.0)  # a direction without spread cannot be scaled to one
        self.values, self.vectors = values[real], vectors[:, order[real]]
        self.explained = self.values / trace if trace > 0 else self.values

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """The exact squared distance from n times the mean, null beyond a long, and the whitened components."""
        n, rest = self.n, np.array(self.rest, np.int64)
        y = _less(x, np.array(self.centre, np.int64))
        big = n * (largest(y) + 1)
        far = exact(y, big * big * y.shape[1]) * n - rest
        deviation = [int(d) if d <= LONG else None for d in (far * far).sum(1).tolist()]
        return deviation, (y.astype(np.float64) - rest / n) @ (self.vectors / np.sqrt(self.values))


def fits(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each width among ``rows`` (vec_id, width, vec): first the sums of all dimensions, then their squares."""
    totals = _collected(saved(rows.mapInArrow(_totals, SUMS), "whitening-sums"))
    means = {w: [own[d, d] for d in range(w)] for w, (_, own) in totals.items()}
    centres = {w: [s // totals[w][0] for s in means[w]] for w in means}
    square = _collected(saved(rows.mapInArrow(_squares(centres), SUMS), "whitening-squares")) if centres else {}
    return {w: Fit(totals[w][0], means[w], square[w][1], components) for w in totals}


def _projected(found: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, rows, x in _by_width(batches):
            deviation, z = found[w].apply(x)
            ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.record_batch(
                [rows.column("vec_id"), rows.column("width"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))],
                names=["vec_id", "width", "deviation", "z"],
            )

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the components (j = -1) and of their products; they are centred already, up to rounding."""
    held: dict = defaultdict(float)
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for w in np.unique(widths).tolist():
            own = batch.filter(pa.array(widths == w)).column("z")
            z = own.flatten().to_numpy().reshape(len(own), -1)
            for i in range(z.shape[1]):
                held[w, i, -1] += z[:, i].sum()
                for j in range(i, z.shape[1]):
                    held[w, i, j] += z[:, i] @ z[:, j]
    keys = list(held)
    columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
    yield pa.record_batch([*columns, pa.array([held[k] for k in keys], pa.float64())], names=["width", "i", "j", "s"])


def _identity_error(placed: DataFrame, found: dict[int, Fit]) -> dict[int, float]:
    """By width the largest entry of the whitened rows' covariance less the identity."""
    sums = placed.select("width", "z").mapInArrow(_moments, "width int, i int, j int, s double")
    total = {(r["width"], r["i"], r["j"]): r["s"] for r in sums.groupBy("width", "i", "j").agg(F.sum("s").alias("s")).collect()}
    error: dict[int, float] = defaultdict(float)
    for (w, i, j), s in total.items():
        if j >= 0:
            n = found[w].n
            off = s / n - total[w, i, -1] / n * (total[w, j, -1] / n) - (i == j)
            error[w] = max(error[w], abs(off))
    return error


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold a null or non-finite number are left out, and so are empty ones, which have no
    component. Those of each width are a fit list of their own; a table of embeddings has one width, and one with more
    different widths than the driver can hold covariances for is refused (``MOST_SUMS``). Components are
    numbered from 1 by falling eigenvalue; one without spread (one vector, equal vectors, fewer vectors than
    dimensions) gives no row. A deviation that no long holds is null. A null id is carried along, repeated rows count
    and are returned each, ties among eigenvalues leave any basis of their space, the same for all rows. An empty table
    gives an empty result. Other columns are ignored.

    Tasks send exact sums, one for each dimension and pair of dimensions; the driver puts them together, however many
    the rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(finite("vec") & (F.size("vec") > 0)).select("vec_id", F.size("vec").alias("width"), "vec")
    found = fits(rows, components)
    schema = "vec_id long, width int, deviation long, z array<double>"
    placed = saved(rows.mapInArrow(_projected(found), schema), "whitened")
    error = _identity_error(placed, found)
    facts = [
        (w, k + 1, fit.n, float(share), float(error[w])) for w, fit in found.items() for k, share in enumerate(fit.explained)
    ]
    facts = spark.createDataFrame(facts, "width int, component int, n long, explained double, identity_error double")
    each = placed.select("vec_id", "width", "deviation", F.posexplode("z").alias("place", "whitened"))
    each = each.withColumn("component", F.col("place") + 1)
    # Facts have a row for each component of a width: bounded by the sums that the driver took.
    joined = each.join(F.broadcast(facts), ["width", "component"])
    return joined.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
