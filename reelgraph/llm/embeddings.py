"""Embedding near-duplicates by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import Unions, arrow_batches, saved
from reelgraph.operators.clustering import connected_components

COSINE = 0.93
PIVOTS = (1, 4, 16, 64)  # numbers of pivots to choose from; they and their distances are what every task gets
PIVOT_SAMPLE = 4096  # vectors that pivots are chosen from and their worth is measured on; any choice gives the same result
MOVED = 1000  # multiplications that take as long as sending one number on
BLOCK = 2048  # vectors of a cell in one block
SLACK = 1e-6  # added to distances for rounding
TIE = 1e-12  # cosines this close to the bound are computed again, one by one

ASSIGNED = "rep long, n long, label string, home boolean, cell int, vec array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Far-apart unit vectors: each next one is the farthest from those chosen."""
    unit = np.unique(_unit(sample), axis=0)
    chosen = [0]
    far = np.linalg.norm(unit - unit[0], axis=1)
    while len(chosen) < min(most, len(unit)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(unit - unit[chosen[-1]], axis=1))
    return unit[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def near_cells(x: np.ndarray, pivots: np.ndarray, radius: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and the cells where a vector within ``radius`` can be at home.

    With d(v, p) <= d(v, q) for home p, some u at home in q with d(u, v) <= r needs, by the triangle inequality,
    d(v, q) <= d(u, q) + r <= d(u, p) + r <= d(v, p) + 2 r, and d(v, q) <= r + the largest d(u, q) in the cell, which is
    ``reach`` (negative for a cell without vectors). On unit vectors the first bound is sharper as a distance to the
    plane between the pivots.
    """
    d = distances(_unit(x), pivots)
    apart = np.maximum(distances(pivots, pivots), SLACK)
    home = d.argmin(1)
    least = d[np.arange(len(d)), home]
    near = (reach >= 0) & (d <= reach + radius) & (d - least[:, None] <= 2 * radius)
    near &= d**2 - least[:, None] ** 2 <= 2 * radius * apart[home]
    near[np.arange(len(d)), home] = True
    return home, near


def worthwhile_pivots(sample: np.ndarray, radius: float, rows: float) -> np.ndarray:
    """As many pivots as make the least work: pairs that still meet, of ``rows`` vectors, and copies sent to cells."""
    every = choose_pivots(sample, max(PIVOTS))
    costs = []
    for k in sorted({min(k, len(every)) for k in PIVOTS}):
        d = distances(_unit(sample), every[:k])
        reach = np.full(k, -1.0)
        np.maximum.at(reach, d.argmin(1), d.min(1) + SLACK)
        home, near = near_cells(sample, every[:k], radius, reach)
        pairs = (np.bincount(home, minlength=k) * near.sum(0)).sum() / len(sample) ** 2
        costs.append((pairs * rows + MOVED * near.sum() / len(sample), k))
    return every[: min(costs)[1]]


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
    for w in np.unique(widths).tolist():
        yield w, batch if (widths == w).all() else batch.take(pa.array(np.flatnonzero(widths == w)))


def _assign(pivots: dict[int, np.ndarray], radius: float, reach: dict[int, np.ndarray]):
    """Each vector at home and in the other cells that it may be near to; one of a width without pivots in the only cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows in _by_width(batch) if batch.num_rows else ():
                if w in pivots:
                    home, near = near_cells(_matrix(rows.column("vec")), pivots[w], radius, reach[w])
                else:
                    home, near = np.zeros(rows.num_rows, int), np.ones((rows.num_rows, 1), bool)
                row, cell = np.nonzero(near)
                part = rows.take(pa.array(row))
                yield pa.record_batch(
                    [part.column("rep"), part.column("n"), part.column("label"), pa.array(cell == home[row]), pa.array(cell.astype(np.int32)), part.column("vec")],
                    names=["rep", "n", "label", "home", "cell", "vec"],
                )

    return run


def _home(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows in _by_width(batch) if batch.num_rows else ():
                if w in pivots:
                    d = distances(_unit(_matrix(rows.column("vec"))), pivots[w])
                    yield pa.record_batch(
                        [pa.array([w] * len(d), pa.int32()), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["width", "cell", "d"]
                    )

    return run


def _cosines(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least ``cosine``."""
    s = _unit(a) @ _unit(b).T
    hit = s >= cosine
    for i, j in zip(*np.nonzero(np.abs(s - cosine) < TIE), strict=True):
        hit[i, j] = math.fsum(a[i] * b[j]) / (math.sqrt(math.fsum(a[i] ** 2)) * math.sqrt(math.fsum(b[j] ** 2))) >= cosine
    return hit


def _join(cosine: float):
    """Pairs of blocks of a cell: how many vectors each one at home meets, and links with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                side = [[batch.column(s).field(f)[k].values for f in ("rep", "n", "vec")] for s in ("x", "y")]
                (xr, _, xv), (yr, yn, yv) = side
                xr, yr, yn = xr.to_numpy(), yr.to_numpy(), yn.to_numpy()
                hit = _cosines(_matrix(xv), _matrix(yv), cosine)
                hit &= xr[:, None] != yr[None, :]
                met = hit @ yn
                ids = np.unique(np.concatenate([xr, yr]))
                unions = Unions(len(ids))
                i, j = np.nonzero(hit)
                unions.link(np.searchsorted(ids, xr[i]), np.searchsorted(ids, yr[j]))
                member, root = unions.links()
                some = met > 0
                yield pa.record_batch(
                    [pa.array(np.concatenate([xr[some], ids[member]])), pa.array(np.concatenate([met[some], np.zeros(len(member), np.int64)])),
                     pa.array([None] * int(some.sum()) + ids[root].tolist(), pa.int64())],
                    names=["rep", "met", "to"],
                )

    return run


def _blocked(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members of each cell as blocks of about BLOCK vectors."""
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).alias("salt")
    salted = members.join(sizes, ["label", "cell"]).select("label", "cell", salt, F.struct("rep", "n", "vec").alias("m"))
    lists = salted.groupBy("label", "cell", "salt").agg(F.collect_list("m").alias("m"))
    return lists.select("label", "cell", F.struct(*(F.col("m").getField(f).alias(f) for f in ("rep", "n", "vec"))).alias("m"))


def valid(vec: str):
    """Vectors that can link: not null, of numbers that are all finite, not all zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors linked at ``cosine`` or more within equal labels.

    Equal vectors of a label become one row with a count. Pivots cut the rest into cells; each cell is joined for
    itself, with the vectors from beyond its border that may be near, in pairs of blocks of bounded size, so a cell of
    any size is many rows of work. Only counts and spanning links leave a block pair. How many pivots there are follows
    from what they save on a sample; where they would prune next to nothing there is one cell, and nothing is copied.

    Vectors that are null, zero, or hold a null or non-finite number link with nothing, nor do those with a null label or
    a null id: they stand alone. Vectors of different widths do not link; those of each width are joined for themselves.
    Repeated rows count as other vectors. An empty table gives an empty result. Other columns are ignored.
    """
    # Only vectors of one width can be compared, so the width is part of the label.
    label = F.concat(F.size(vec_col).cast("string"), F.lit(" "), F.col(label_col).cast("string"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = rows.filter(valid("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    same = fit.groupBy("label", "vec").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"))
    reps = saved(same.withColumn("rep", F.monotonically_increasing_id()), "vector-reps")  # fixed once written
    met, roots = _linked(reps, cosine) if reps.head(1) else (None, None)
    if met is None:
        classes = reps.select("label", "vec", F.lit(0).cast("long").alias("more"), F.col("head").alias("component"))
    else:
        joined = reps.join(met, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
        least = joined.groupBy("root").agg(F.min("head").alias("least"))
        classes = joined.join(least, "root").select(
            "label", "vec", (F.coalesce("met", F.lit(0)) + F.col("n") - 1).alias("more"), F.col("least").alias("component")
        )
    able = rows.withColumn("vec", F.when(valid("vec") & F.col("vec_id").isNotNull(), F.col("vec")))
    joined = able.join(classes, ["label", "vec"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("more", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _linked(reps: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    spark = reps.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    sample = [np.array(r[0], np.float64) for r in reps.select("vec").limit(PIVOT_SAMPLE).collect()]
    by_width: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)
    # Of how many others a vector's label has: the sum of squares over the number.
    sizes = reps.groupBy("label").count().agg(F.sum(F.col("count").cast("double") ** 2), F.sum("count")).first()
    pivots = {w: worthwhile_pivots(np.array(own), radius, sizes[0] / sizes[1]) for w, own in by_width.items()}
    with arrow_batches(spark, 4096):
        reach = {w: np.full(len(p), -1.0) for w, p in pivots.items()}
        if any(len(p) > 1 for p in pivots.values()):
            homes = reps.select("vec").mapInArrow(_home(pivots), "width int, cell int, d double")
            for w, cell, far in homes.groupBy("width", "cell").agg(F.max("d")).collect():  # a number for each pivot
                reach[w][cell] = far + SLACK
        placed = saved(
            reps.select("rep", "n", "label", "vec").mapInArrow(_assign(pivots, radius, reach), ASSIGNED), "vector-members"
        )
    with arrow_batches(spark, 4):
        home, every = placed.filter("home"), placed
        sides = []
        for side in (home, every):
            sizes = side.groupBy("label", "cell").agg(F.count("*").alias("size"))
            sides.append(_blocked(side.select("rep", "n", "label", "cell", "vec"), sizes))
        pairs = sides[0].withColumnRenamed("m", "x").join(sides[1].withColumnRenamed("m", "y"), ["label", "cell"]).select("x", "y")
        out = saved(pairs.mapInArrow(_join(cosine), "rep long, met long, to long"), "vector-links")
    met = out.groupBy("rep").agg(F.sum("met").alias("met"))
    edges = out.filter("to is not null").select(F.col("rep").alias("src"), F.col("to").alias("dst"))
    nodes = edges.select(F.col("src").alias("rep")).union(edges.select(F.col("dst").alias("rep"))).distinct()
    return met, connected_components(nodes, edges, "rep")
