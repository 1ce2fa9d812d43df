"""Exact similarity work between two vector tables.

A similarity join has no equality to hash on, so every operator here evaluates dot products with matrix products
on Arrow batches inside Spark tasks, and sends on only what the operator asks for: the best k, the best one, rows
over a threshold, or partial sums. Two layouts:

* ``broadcast``: one side is at most ``BROADCAST_BYTES`` (measured, not assumed). It is sent to every task and the
  other side is scanned once, without a shuffle.
* ``passes``: both sides are large. One side is written once to the shared folder in parts of bounded size. The other
  stays where it is: a task takes a block of its rows and reads part after part past it, so no vector is shuffled again
  and nothing is copied for each pair of blocks. A self-join writes its parts by hash of the id; the task of a part
  reads the half of the others that follow it in a circle, which visits each unordered pair once and gives all tasks
  the same work.

``fold_scores`` keeps the best k, the best one or a count as state of a resident block of rows while the other side passes
by, and emits it once; ``join_scores`` is for results that cannot be merged before they leave.

Results leave a task tile by tile. Scores are rounded to 12 digits before they are compared, so that exact copies tie
wherever they are stored; ties go to the smallest id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.session import checkpoint_dir, cut

# What a task holds is a few times these: several tasks share an executor, and each converts and normalises its rows.
BROADCAST_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
HELD_BYTES = 32 << 20  # rows and their state that a task holds while parts pass by
TILE_CELLS = 1 << 20
MOST_PARTS = 64  # of a self-join whose rows would fit fewer: beyond, parts grow up to a block

Block = tuple[np.ndarray, np.ndarray]  # ids (or payload columns), unit vectors as rows


# ---------------------------------------------------------------- Arrow <-> numpy


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column -> float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    if rows.size == 0:
        return rows
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows / np.where(lengths > 0, lengths, 1.0)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a @ b.T, 12)


def read_block(table: pa.Table | pa.RecordBatch, keys: list[str], vec: str, normalise: bool) -> tuple[dict, np.ndarray]:
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    columns = {k: table.column(k).to_numpy() for k in keys}
    rows = matrix(table.column(vec))
    return columns, unit(rows) if normalise else rows


def tiles(n_rows: int, n_cols: int) -> Iterator[slice]:
    step = max(1, TILE_CELLS // max(1, n_cols))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


# ---------------------------------------------------------------- layouts


def shape(df: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, width) of a vector table; the width is that of one vector, so the count reads no values."""
    one = df.filter(F.size(vec) > 0).select(F.size(vec).alias("d")).head(1)
    return df.count(), one[0]["d"] if one else 1


def join_scores(
    small: DataFrame,
    large: DataFrame,
    kernel: Callable,
    schema: str,
    *,
    small_keys: list[str],
    large_keys: list[str],
    vec: str = "embedding",
    normalise: bool = True,
    broadcast_bytes: int | None = None,
    part_rows: int | None = None,
    cut_blocks: Callable | None = None,
) -> DataFrame:
    """Run ``kernel(small_block, large_block)``, which yields dicts of columns, over all pairs of the two tables.

    ``small`` is broadcast when its measured size allows, else its parts are read past the blocks of ``large``. The
    kernel sees each (small row, large row) pair exactly once, but spread over several calls, so its output must be
    mergeable. ``cut_blocks(batches, bytes)`` cuts the large side where the kernel needs it.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    small = small.select(*small_keys, vec)
    large = large.select(*large_keys, vec)
    n_small, width = shape(small, vec)
    fields, block_bytes, in_blocks = pa_schema(schema), BLOCK_BYTES, cut_blocks or blocks

    if n_small * width * 8 <= limit:
        held = large.sparkSession.sparkContext.broadcast(read_block(small.toArrow(), small_keys, vec, normalise))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = held.value
            for block in in_blocks(batches, block_bytes) if len(left[1]) else ():
                yield from emit(kernel(left, read_block(block, large_keys, vec, normalise)), fields)

        return large.mapInArrow(scan, schema)

    n_parts = max(1, math.ceil(n_small / (part_rows or rows_per_block(width))))
    folder = parts_of(small, n_parts, small_keys[0])

    def scan_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, block_bytes):
            right = read_block(block, large_keys, vec, normalise)
            for k in range(n_parts):
                left = read_part(folder, k, [*small_keys, vec])
                if left is not None:
                    yield from emit(kernel(read_block(left, small_keys, vec, normalise), right), fields)

    return large.mapInArrow(scan_parts, schema)


def fold_scores(
    held: DataFrame,
    passed: DataFrame,
    fold,
    schema: str,
    *,
    held_keys: list[str],
    passed_keys: list[str],
    send: str,
    vec: str = "embedding",
    normalise: bool = True,
    broadcast_bytes: int | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """The state of every ``held`` row after every ``passed`` row, emitted once by the task that holds it.

    ``fold.start(block)`` makes the state of a block of held rows, ``fold.add(state, block)`` takes in passed rows, and
    ``fold.rows(state)`` yields the columns that leave; ``fold.state_bytes`` is its size per held row. ``send`` names the
    side that is sent to every task when it is small. If that is the held side, each task folds its own passed rows and
    the states of the tasks are left to merge; otherwise a row's state is whole. When the side is not small, the
    passed rows are written in parts and read past blocks of held rows, so no state leaves before all parts have passed.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    held, passed = held.select(*held_keys, vec), passed.select(*passed_keys, vec)
    spark, fields, block_bytes = held.sparkSession, pa_schema(schema), BLOCK_BYTES
    if send == "held":
        n, width = shape(held, vec)
        if n * (8 * width + fold.state_bytes) <= limit:
            asked = spark.sparkContext.broadcast(read_block(held.toArrow(), held_keys, vec, normalise))

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                state = fold.start(asked.value)
                for block in blocks(batches, block_bytes) if len(asked.value[1]) else ():
                    fold.add(state, read_block(block, passed_keys, vec, normalise))
                yield from emit(fold.rows(state), fields)

            return passed.mapInArrow(scan, schema)
        n, part_width = shape(passed, vec)
    else:
        n, width = shape(passed, vec)
        part_width = width
    most = max(1, HELD_BYTES // (8 * width + fold.state_bytes))
    if send == "passed" and n * width * 8 <= limit:
        sent = spark.sparkContext.broadcast(read_block(passed.toArrow(), passed_keys, vec, normalise))

        def parts() -> Iterator[Block]:
            if len(sent.value[1]):
                yield sent.value
    else:
        n_parts = max(1, math.ceil(n / (part_rows or rows_per_block(part_width))))
        folder = parts_of(passed, n_parts, passed_keys[0])

        def parts() -> Iterator[Block]:
            for k in range(n_parts):
                table = read_part(folder, k, [*passed_keys, vec])
                if table is not None and table.num_rows:
                    yield read_block(table, passed_keys, vec, normalise)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, HELD_BYTES, most):
            state = fold.start(read_block(block, held_keys, vec, normalise))
            for part in parts():
                fold.add(state, part)
            yield from emit(fold.rows(state), fields)

    return held.mapInArrow(hold, schema)


def parts_of(df: DataFrame, n: int, key: str) -> str:
    """A folder in the shared place with ``df`` in ``n`` parts by hash of ``key``."""
    folder = f"{checkpoint_dir(df.sparkSession)}/vectors-{uuid.uuid4()}"
    placed = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    placed.repartition(n, "_part").write.partitionBy("_part").parquet(folder)
    return folder


def read_part(folder: str, k: int | str, columns: list[str]) -> pa.Table | None:
    """One part, read by the task that needs it; None where no row fell into it."""
    fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder.removeprefix("file:"))
    path = f"{root}/_part={k}"
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return None
    return pq.read_table(path, columns=columns, filesystem=fs, partitioning=None, use_threads=False)


def blocks(batches: Iterator[pa.RecordBatch], most: int, most_rows: int | None = None) -> Iterator[pa.Table]:
    """Batches put together until they hold about ``most`` bytes, or ``most_rows``."""
    held, size, rows = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            rows += batch.num_rows
        if size >= most or (most_rows and rows >= most_rows):
            yield pa.Table.from_batches(held)
            held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def self_join_scores(
    df: DataFrame,
    kernel: Callable,
    schema: str,
    *,
    id_col: str = "seq",
    vec: str = "embedding",
    group: str | None = None,
    normalise: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``kernel(block_a, block_b, same)``, which yields dicts of columns, over each unordered pair of rows once.

    With ``group`` only rows of the same group meet; a group is split into as many blocks as its size asks for, so
    one that holds a third of the table is spread over many tasks. ``same`` tells that both blocks are one block.
    """
    run = self_join(df, kernel, id_col=id_col, vec=vec, group=group, normalise=normalise, block_rows=block_rows)
    return run(None, schema)


def self_join(
    df: DataFrame,
    kernel: Callable,
    *,
    id_col: str = "seq",
    vec: str = "embedding",
    group: str | None = None,
    normalise: bool = True,
    block_rows: int | None = None,
) -> Callable[[Callable | None, str], DataFrame]:
    """The join of ``self_join_scores`` for one or more passes: blocks are placed once.

    A pass is ``run(finish, schema)``: ``finish`` takes all that the kernel yields in a task, and yields what leaves it.
    """
    df = df.select(*([F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]), F.col(id_col).alias("_id"), vec)
    n, width = shape(df, vec)
    rows = block_rows or rows_per_block(width)
    if group:
        sizes = df.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(rows))).cast("int").alias("_n"))
        sizes = cut(sizes.withColumn("_i", F.monotonically_increasing_id()))
        sized = df.join(sizes, "_g")
        # Groups of one block share tasks: a bucket holds about a block of rows, and each group in it is a call.
        buckets = max(1, math.ceil(n / rows), min(df.sparkSession.sparkContext.defaultParallelism, n // 512))
        small = sized.filter("_n = 1").withColumn("_bucket", F.pmod(F.xxhash64("_g"), F.lit(buckets))).drop("_n", "_i")
    else:
        # Each part meets half of the others, so the reads grow with the square of their number.
        parts = max(math.ceil(n / max(rows, min(n / MOST_PARTS, rows_per_block(width)))), 1)
        parts = max(parts, min(df.sparkSession.sparkContext.defaultParallelism // 2 + 1, n // 512))
        return _circle(df, parts, kernel, vec, normalise)

    def calls(table: pa.Table) -> Iterator[dict]:
        table = table.sort_by("_g")
        codes = pc.rank(table.column("_g"), tiebreaker="min", null_placement="at_start").to_numpy()
        edges = np.flatnonzero(np.diff(codes, prepend=0, append=0))
        for start, end in zip(edges, edges[1:]):
            block = read_block(table.slice(start, end - start), ["_id"], vec, normalise)
            yield from kernel(block, block, True)

    def in_buckets(finish: Callable | None, schema: str) -> DataFrame:
        fields = pa_schema(schema)
        each = lambda table: whole(finish(calls(table)) if finish else calls(table), fields)
        return small.groupBy("_bucket").applyInArrow(each, schema)

    large = sizes.filter("_n > 1 and _g is not null")
    n_blocks = large.agg(F.sum("_n")).first()[0]
    if n_blocks is None:
        return in_buckets
    in_blocks = _grouped(sized.filter("_n > 1"), large, n_blocks, kernel, vec, normalise)
    return lambda finish, schema: in_blocks(finish, schema).unionByName(in_buckets(finish, schema))


def _circle(df: DataFrame, n: int, kernel: Callable, vec: str, normalise: bool) -> Callable:
    """All unordered pairs of ``n`` parts: that of part k with the n / 2 parts after it."""
    folder = parts_of(df.select("_id", vec), n, "_id")

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def block(k: int):
            table = read_part(folder, k, ["_id", vec])
            return None if table is None else read_block(table, ["_id"], vec, normalise)

        for k in (k for batch in batches for k in batch.column("id").to_pylist()):
            own = block(k)
            for step in range(n // 2 + 1 if own is not None else 0):
                other = (k + step) % n
                if 2 * step == n and k > other:  # opposite parts meet once
                    continue
                with_ = own if step == 0 else block(other)
                if with_ is not None:
                    yield from kernel(own, with_, step == 0)

    return _pass(lambda: df.sparkSession.range(0, n, 1, n), calls)


def _pass(tasks: Callable[[], DataFrame], calls: Callable) -> Callable[[Callable | None, str], DataFrame]:
    """What a self-join returns: runs ``calls`` in each task, and ``finish`` on what they yield."""

    def run(finish: Callable | None, schema: str) -> DataFrame:
        fields = pa_schema(schema)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from emit(finish(calls(batches)) if finish else calls(batches), fields)

        return tasks().mapInArrow(task, schema)

    return run


def _grouped(df: DataFrame, sizes: DataFrame, n: int, kernel: Callable, vec: str, normalise: bool) -> Callable:
    """Pairs of blocks inside each group, which has a number (_i) and ``_n`` blocks; ``n`` are all blocks.

    Blocks are written once to the shared folder; a task reads the two of a pair, and results leave it tile by tile.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/vectors-{uuid.uuid4()}"
    placed = df.withColumn("_part", F.concat_ws("-", "_i", F.pmod(F.xxhash64("_id"), F.col("_n"))))
    placed.select("_id", vec, "_part").repartition(n, "_part").write.partitionBy("_part").parquet(folder)
    firsts = sizes.select("_i", "_n", F.explode(F.expr("sequence(0, _n - 1)")).alias("_a"))
    pairs = cut(firsts.select("_i", "_a", F.explode(F.expr("sequence(_a, _n - 1)")).alias("_b")))
    tasks = max(1, min(pairs.count(), 64 * df.sparkSession.sparkContext.defaultParallelism))

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for i, a, b in (pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            tables = [read_part(folder, f"{i}-{k}", ["_id", vec]) for k in dict.fromkeys((a, b))]
            if all(t is not None for t in tables):
                read = [read_block(t, ["_id"], vec, normalise) for t in tables]
                yield from kernel(read[0], read[-1], a == b)

    return _pass(lambda: pairs.repartition(tasks), calls)


def rows_per_block(width: int) -> int:
    return max(256, BLOCK_BYTES // (8 * width))


def pa_schema(schema: str) -> pa.Schema:
    """Arrow schema of a "name type, ..." string made of long, int, double, string and binary columns."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    pairs = (part.split() for part in schema.split(","))
    return pa.schema([(name, types[kind]) for name, kind in pairs])


def whole(parts: Iterator[dict], fields: pa.Schema) -> pa.Table:
    return pa.concat_tables([fields.empty_table(), *(as_table(p, fields) for p in parts)])


def as_table(columns: dict, fields: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in fields})


def emit(parts: Iterator[dict], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One tile at a time, so that a task holds one tile of results."""
    for part in parts:
        yield from as_table(part, fields).to_batches(max_chunksize=65536)


# ---------------------------------------------------------------- kernels


class BestK:
    """Per query (held) the k best rows, ties by smallest id; a score that is not a number counts as the lowest."""

    def __init__(self, k: int):
        self.k, self.state_bytes = k, 16 * k

    def start(self, queries: Block) -> dict:
        cols, rows = queries
        return {
            "_q": cols["_q"], "rows": rows, "ids": np.full((len(rows), self.k), np.iinfo(np.int64).max),
            "scores": np.full((len(rows), self.k), -np.inf),
        }

    def add(self, state: dict, block: Block) -> None:
        ids, rows = block[0]["_id"], block[1]
        order = np.argsort(ids, kind="stable")
        ids, rows, take = ids[order], rows[order], min(self.k, len(ids))
        for part in tiles(len(state["rows"]), len(ids)):
            s = similarities(state["rows"][part], rows)
            s[np.isnan(s)] = -np.inf
            open_ = np.flatnonzero(s.max(axis=1) >= state["scores"][part][:, -1]) if take else ()
            if not len(open_):
                continue
            s, at = s[open_], part.start + open_
            if take == len(ids):
                pick = np.tile(np.arange(take), (len(s), 1))
            else:
                pick = np.argpartition(-s, take - 1, axis=1)[:, :take]
                floor = np.take_along_axis(s, pick, axis=1).min(axis=1)
                for i in np.flatnonzero((s >= floor[:, None]).sum(axis=1) > take):
                    pick[i] = np.argsort(-s[i], kind="stable")[:take]
            both_ids = np.concatenate([state["ids"][at], ids[pick]], axis=1)
            both = np.concatenate([state["scores"][at], np.take_along_axis(s, pick, axis=1)], axis=1)
            best = np.lexsort((both_ids, -both), axis=1)[:, : self.k]
            state["ids"][at] = np.take_along_axis(both_ids, best, axis=1)
            state["scores"][at] = np.take_along_axis(both, best, axis=1)

    def rows(self, state: dict) -> Iterator[dict]:
        for part in tiles(len(state["ids"]), self.k):
            i, j = np.nonzero(state["scores"][part] > -np.inf)
            yield {"query_id": state["_q"][part][i], "id": state["ids"][part][i, j], "score": state["scores"][part][i, j]}


class BestOne:
    """Per held row its best partner, ties to the smallest; ``mode`` limits partners: any, earlier (id) or other (id)."""

    state_bytes = 16

    def __init__(self, mode: str = "any"):
        self.mode = mode

    def start(self, rows: Block) -> dict:
        n = len(rows[1])
        return {"_id": rows[0]["_id"], "rows": rows[1], "top": np.full(n, -np.inf), "partner": np.zeros(n, np.int64)}

    def add(self, state: dict, partners: Block) -> None:
        order = np.argsort(partners[0]["_p"], kind="stable")
        pids, pmat = partners[0]["_p"][order], partners[1][order]
        for part in tiles(len(state["rows"]), len(pids)):
            ids = state["_id"][part]
            s = similarities(state["rows"][part], pmat)
            s[np.isnan(s)] = -np.inf
            if self.mode == "earlier":
                s[pids[None, :] >= ids[:, None]] = -np.inf
            elif self.mode == "other":
                s[pids[None, :] == ids[:, None]] = -np.inf
            j = s.argmax(axis=1)
            top, found = s[np.arange(len(ids)), j], pids[j]
            old, partner = state["top"][part], state["partner"][part]
            better = (top > old) | ((top == old) & (found < partner))
            state["top"][part] = np.where(better, top, old)
            state["partner"][part] = np.where(better, found, partner)

    def rows(self, state: dict) -> Iterator[dict]:
        ok = np.isfinite(state["top"])
        yield {"id": state["_id"][ok], "partner": state["partner"][ok], "sim": state["top"][ok]}


def earlier_in_reach(threshold: float, strict: bool = False):
    """Rows of the large side that a row of the small side with a smaller id reaches."""

    def kernel(partners, rows):
        (pcols, pmat), (rcols, rmat) = partners, rows
        for part in tiles(len(rmat), len(pmat)):
            s = similarities(rmat[part], pmat)
            ids = rcols["_id"][part]
            hit = (s > threshold if strict else s >= threshold) & (pcols["_p"][None, :] < ids[:, None])
            yield {"id": ids[hit.any(axis=1)]}

    return kernel


def over_threshold(threshold: float, strict: bool = False):
    """Pairs of a self-join at or above the threshold, smaller id first."""

    def kernel(a, b, same):
        (acols, amat), (bcols, bmat) = a, b
        aid, bid = acols["_id"], bcols["_id"]
        for part in tiles(len(amat), len(bmat)):
            s = similarities(amat[part], bmat)
            hit = s > threshold if strict else s >= threshold
            if same:
                hit &= aid[part][:, None] < bid[None, :]
            i, j = np.nonzero(hit)
            x, y = aid[part][i], bid[j]
            yield {"src": np.minimum(x, y), "dst": np.maximum(x, y), "sim": s[i, j]}

    return kernel


def spanning_stars(threshold: float):
    """Edges (src, dst) that connect the same rows as all pairs over the threshold do within two blocks.

    At most one edge per row leaves the task, however dense the block is.
    """

    def kernel(a, b, same):
        (acols, amat), (bcols, bmat) = a, b
        ids = np.unique(np.concatenate([acols["_id"], bcols["_id"]]))
        at, bt = np.searchsorted(ids, acols["_id"]), np.searchsorted(ids, bcols["_id"])
        root = np.arange(len(ids))
        step = max(1, (TILE_CELLS // 8) // max(1, len(bt)))
        for start in range(0, len(at), step):
            part = slice(start, start + step)
            i, j = np.nonzero(similarities(amat[part], bmat) >= threshold)
            root = hook(root, at[part][i], bt[j])
        moved = root != np.arange(len(ids))
        yield {"src": ids[root[moved]], "dst": ids[moved]}

    return kernel


def hook(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest-member roots after joining the components of x[i] and y[i]."""
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            return root
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def group_blocks(group: str, piece: str):
    """Cuts rows sorted by ``group`` into blocks at the ends of groups.

    A group beyond a block is passed on in pieces, whose ``piece`` is set to 1; 0 says that the block has all of the group.
    """

    def cut_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
        held, size, open_ = [], 0, None  # open_: the group that was cut

        def out(table: pa.Table) -> pa.Table:
            if open_ is None:
                return table
            cut = pc.or_(pc.equal(table.column(group), open_), pc.greater(table.column(piece), 0))
            at = table.schema.get_field_index(piece)
            return table.set_column(at, piece, pc.cast(cut, pa.int64()))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            last = table.column(group)[-1]
            start = pc.index(table.column(group), last).as_py()
            if start == 0:  # one group only
                open_ = last
                yield out(table)
                held, size = [], 0
            else:
                yield out(table.slice(0, start))
                rest = table.slice(start)
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield out(pa.Table.from_batches(held))

    return cut_blocks


def pooled_parts(tau: float, at_least: float | None = None, relative: float = 0.0, few: int = 0):
    """Per (query, video) the maximum, the shifted exponential sum and the count of frame similarities.

    With ``at_least`` a video whose frames are all in the block (``_piece`` 0) is scored there. It does not leave when it
    is below that bound, or below both ``relative`` times the block's best and the block's ``few`` best: the bests of the
    whole table can only be higher. Bounds are lowered a little, so that rounding decides nothing here.
    """

    def kernel(queries, frames):
        (qcols, qmat), (fcols, fmat) = queries, frames
        order = np.argsort(fcols["_video"], kind="stable")
        videos, starts = np.unique(fcols["_video"][order], return_index=True)
        counts = np.diff(np.append(starts, len(order)))
        fmat = fmat[order]
        whole_ = fcols["_piece"][order][starts] == 0 if at_least is not None else None
        for part in tiles(len(qmat), len(fmat)):
            s = similarities(qmat[part], fmat)
            top = np.maximum.reduceat(s, starts, axis=1)
            e = np.add.reduceat(np.exp((s - np.repeat(top, counts, axis=1)) / tau), starts, axis=1)
            keep = np.ones(top.shape, bool)
            if at_least is not None and whole_.any():
                score = (tau * np.log(e / counts) + top)[:, whole_]
                floor = np.full(len(score), -np.inf)
                if score.shape[1] >= few:
                    floor = np.minimum(relative * score.max(axis=1), -np.partition(-score, few - 1, axis=1)[:, few - 1])
                keep[:, whole_] = score >= np.maximum(at_least, floor)[:, None] - 1e-9
            i, j = np.nonzero(keep)
            yield {
                "query_id": qcols["_q"][part][i], "video_id": videos[j], "top": top[i, j], "mass": e[i, j], "n": counts[j],
            }

    return kernel


def all_scores():
    """Every (small row, large row) score; for small sides that are a fixed vocabulary."""

    def kernel(labels, rows):
        (lcols, lmat), (rcols, rmat) = labels, rows
        for part in tiles(len(rmat), len(lmat)):
            s = similarities(rmat[part], lmat)
            yield {
                "item_id": np.repeat(rcols["_id"][part], len(lmat)),
                "label_ord": np.tile(lcols["_l"], len(s)),
                "sim": s.ravel(),
            }

    return kernel


def exemplar_boosts(floor: float, top: float, weight: float):
    """Per (row, label) the sum of exemplar boosts in the block; rows without any boost are not sent."""

    def kernel(exemplars, rows):
        (ecols, emat), (rcols, rmat) = exemplars, rows
        labels, where = np.unique(ecols["_l"], return_inverse=True)
        member = np.zeros((len(where), len(labels)))
        member[np.arange(len(where)), where] = 1.0
        for part in tiles(len(rmat), len(emat)):
            s = np.clip(similarities(rmat[part], emat), 0.0, 1.0)
            total = np.where(s > floor, weight * (s - floor) / (top - floor), 0.0) @ member
            i, j = np.nonzero(total)
            yield {"item_id": rcols["_id"][part][i], "label_ord": labels[j], "boost": total[i, j]}

    return kernel


def _pair_scores(a, b, same) -> Iterator[np.ndarray]:
    """The scores of the pairs of a self-join, a tile at a time."""
    (acols, amat), (bcols, bmat) = a, b
    for part in tiles(len(amat), len(bmat)):
        s = similarities(amat[part], bmat)
        yield s[acols["_id"][part][:, None] < bcols["_id"][None, :]] if same else s.ravel()


def all_pair_scores():
    """The scores of the pairs of a self-join, for a ``finish`` that sorts or counts them."""

    def kernel(a, b, same):
        for s in _pair_scores(a, b, same):
            yield {"score": s}

    return kernel


def score_moments(threshold: float):
    """Number, sum and sum of squares of the scores of a self-join, and how many are below the threshold: one row a block."""

    def kernel(a, b, same):
        n, total, squares, below = 0, 0.0, 0.0, 0
        for s in _pair_scores(a, b, same):
            n, total, squares, below = n + s.size, total + s.sum(), squares + (s * s).sum(), below + int((s < threshold).sum())
        yield {"n": [n], "total": [total], "squares": [squares], "below": [below]}

    return kernel


class AheadOfTarget:
    """Per query (held) how many rows beat its target; a query row is its vector followed by the target's."""

    state_bytes = 8

    def start(self, queries: Block) -> dict:
        cols, both = queries
        width = both.shape[1] // 2
        rows, goal = unit(both[:, :width]), unit(both[:, width:])
        own = np.round(np.einsum("ij,ij->i", rows, goal), 12)
        return {**cols, "rows": rows, "own": own, "ahead": np.zeros(len(rows), np.int64)}

    def add(self, state: dict, block: Block) -> None:
        ids, rows = block[0]["_id"], unit(block[1])
        for part in tiles(len(state["rows"]), len(rows)):
            s = similarities(state["rows"][part], rows)
            mine, target = state["own"][part][:, None], state["_t"][part][:, None]
            ahead = (ids[None, :] != target) & ((s > mine) | ((s == mine) & (ids[None, :] < target)))
            state["ahead"][part] += ahead.sum(axis=1)

    def rows(self, state: dict) -> Iterator[dict]:
        yield {"query_id": state["_q"], "ahead": state["ahead"]}
