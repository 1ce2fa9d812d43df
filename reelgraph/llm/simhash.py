"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import Unions, arrow_batches, saved, slices
from reelgraph.operators.clustering import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 16384  # fingerprints in a block at most; two blocks meet in a row
SPREAD = 8  # tasks that the block pairs of a cell are dealt over
FAN = 8  # children of an index node
ROWS, TEXT_BYTES = 1000, 2 << 20  # documents that a task fingerprints at once
TILE = 1 << 12  # node pairs compared at once; each may bring FAN * FAN pairs of children


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, space and \x09-\x0D only
    if not parts:
        return np.empty(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that are set in over half the hashes."""
    hashes = hashes.astype(">u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text); fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            values = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Gray order, cells and blocks


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, with the sign bit turned so that longs sort as unsigned numbers."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(fp: Column, bits: int) -> Column:
    """The first bits of a fingerprint. They are also what its Gray rank's first bits say: a cell is a run in Gray order."""
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("long")


def blocks(codes: DataFrame, bits: int) -> DataFrame:
    """Runs of at most BLOCK fingerprints in Gray order within a cell, with the bits that all of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column("cell").to_numpy(), batch.column("fp").to_numpy()], 1)])
            while len(held):
                end = int(np.searchsorted(held[:, 0] != held[0, 0], True)) if held[-1, 0] != held[0, 0] else len(held)
                if end == len(held) and end < BLOCK:
                    break
                yield _block(held[: min(end, BLOCK)])
                held = held[min(end, BLOCK) :]
        if len(held):
            yield _block(held)

    ranked = codes.select(_prefix(F.col("fp"), bits).alias("cell"), "fp", gray_rank(F.col("fp")).alias("rank"))
    runs = ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("cell", "fp")
    return runs.mapInArrow(run, "cell long, block long, mask long, bits long, fps binary")


def _block(rows: np.ndarray) -> pa.RecordBatch:
    fps = rows[:, 1]
    same = ~(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    return pa.record_batch(
        [pa.array(rows[:1, 0]), pa.array(fps[:1]), pa.array([same]), pa.array([fps[0] & same]), pa.array([fps.tobytes()], pa.binary())],
        names=["cell", "block", "mask", "bits", "fps"],
    )


# ---------------------------------------------------------------- the index and its walk


class Index:
    """A hierarchy over fingerprints in Gray order: a node keeps the bits that all below it share."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.n = fps, len(fps)
        masks, bits = [np.full(len(fps), ~np.uint64(0))], [fps]
        while len(bits[-1]) > 1:
            m, b = (np.concatenate([x, np.repeat(x[-1:], -len(x) % FAN)]).reshape(-1, FAN) for x in (masks[-1], bits[-1]))
            same = np.bitwise_and.reduce(m, 1) & ~(np.bitwise_or.reduce(b, 1) ^ np.bitwise_and.reduce(b, 1))
            masks.append(same)
            bits.append(b[:, 0] & same)
        self.masks, self.bits = masks[::-1], bits[::-1]  # from the root down to the fingerprints

    def grown(self, depth: int) -> Index:
        """The same index below as many further roots as needed to be ``depth`` levels deep."""
        while len(self.bits) < depth:
            self.masks.insert(0, self.masks[0])
            self.bits.insert(0, self.bits[0])
        return self


def matches(a: Index, b: Index, distance: int, done=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of fingerprints at ``distance`` or less, in tiles.

    Pairs of nodes go down both indexes together. Each carries the differences counted in the bits that both of its
    sides share; a level adds only those in bits that are newly shared, and a pair beyond ``distance`` goes with all
    below it. ``done(nodes of a, nodes of b, nodes a node holds)`` may tell pairs of which no link is of use any more.
    """
    depth = max(len(a.bits), len(b.bits))
    a, b = a.grown(depth), b.grown(depth)
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, np.zeros(1, np.uint64), np.zeros(1, np.uint8))]
    while stack:
        level, i, j, shared, differ = stack.pop()
        if len(i) > TILE:
            stack += [(level, i[k : k + TILE], j[k : k + TILE], shared[k : k + TILE], differ[k : k + TILE]) for k in range(0, len(i), TILE)]
            continue
        if level and done is not None:
            use = ~done(i, j, depth - 1 - level)
            i, j, shared, differ = i[use], j[use], shared[use], differ[use]
        both = a.masks[level][i] & b.masks[level][j]
        differ = differ + np.bitwise_count((a.bits[level][i] ^ b.bits[level][j]) & both & ~shared)
        near = differ <= distance
        i, j, shared, differ = i[near], j[near], both[near], differ[near]
        if not len(i):
            continue
        if level == depth - 1:
            yield i, j
            continue
        i, j = _children(a, level, i), _children(b, level, j)
        i, j = np.repeat(i, FAN, axis=1).reshape(-1), np.tile(j, (1, FAN)).reshape(-1)
        shared, differ = np.repeat(shared, FAN * FAN), np.repeat(differ, FAN * FAN)
        real = (i >= 0) & (j >= 0)
        stack.append((level + 1, i[real], j[real], shared[real], differ[real]))


def _children(index: Index, level: int, nodes: np.ndarray) -> np.ndarray:
    """A row of FAN children for each node, -1 where there are fewer."""
    n = len(index.bits[level + 1])
    if n == len(index.bits[level]):  # one of the further roots: its only child
        return np.concatenate([nodes[:, None], np.full((len(nodes), FAN - 1), -1)], 1)
    at = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(at < n, at, -1)


def spanning_links(x: np.ndarray, y: np.ndarray, same: bool, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as all pairs at ``distance`` or less within and between two blocks.

    Between blocks, both are one range of numbers. Node pairs whose fingerprints already hang together are skipped, so
    a dense group costs about one link a member and not all its pairs.
    """
    unions = Unions(len(x) if same else len(x) + len(y))
    shift = 0 if same else len(x)
    left, right = Index(x), Index(x if same else y)

    def one_root(roots: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        groups = np.concatenate([roots, np.repeat(roots[-1:], -len(roots) % span)]).reshape(-1, span)
        return groups.min(1), groups.max(1)

    def done(i: np.ndarray, j: np.ndarray, up: int) -> np.ndarray:
        useless = i > j if same else np.zeros(len(i), bool)
        if up > 2:  # large nodes seldom hang together
            return useless
        la, ha = one_root(unions.root[: len(x)], FAN**up)
        lb, hb = (la, ha) if same else one_root(unions.root[shift:], FAN**up)
        return useless | ((la[i] == ha[i]) & (lb[j] == hb[j]) & (la[i] == lb[j]))

    for i, j in matches(left, right, distance, done):
        unions.link(i, j + shift)
    every = x if same else np.concatenate([x, y])
    member, root = unions.links()
    return every[member], every[root]


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst): links between different fingerprints with the components of all pairs at ``distance`` or less.

    Fingerprints are cut into cells by their first bits, about a block each, and cells into blocks. A block goes to the
    cells at or after its own whose bits differ in at most ``distance`` places; of the block pairs met there, those with
    more differences in the bits that both blocks share are dropped before any Python.
    """
    n = codes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / BLOCK)))
    near = [sum(1 << b for b in chosen) for k in range(min(distance, bits) + 1) for chosen in combinations(range(bits), k)]
    spark = codes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                src, dst = spanning_links(np.frombuffer(x, np.uint64), np.frombuffer(y or x, np.uint64), y is None, distance)
                yield pa.record_batch([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    with arrow_batches(spark, 8):
        b = saved(blocks(codes, bits), "simhash-blocks")
        mask = F.explode(F.array(*[F.lit(m).cast("long") for m in near]))
        sent = b.select("*", mask.alias("turn")).withColumn("to", F.col("cell").bitwiseXOR(F.col("turn"))).filter("to >= cell")
        # Work is in the pairs and not in their bytes: a cell's are dealt over SPREAD tasks, whose number stays as it is.
        share = F.pmod(F.xxhash64("block"), F.lit(SPREAD))
        tasks = SPREAD << min(bits, 12)
        x = sent.withColumn("share", share).repartition(tasks, "to", "share").alias("x")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
        y = b.withColumn("share", each).repartition(tasks, "cell", "share").alias("y")
        differ = F.bit_count(
            F.col("x.bits").bitwiseXOR(F.col("y.bits")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask"))
        )
        pairs = x.join(y, (F.col("x.to") == F.col("y.cell")) & (F.col("x.share") == F.col("y.share"))).filter(
            ((F.col("x.cell") < F.col("y.cell")) | (F.col("x.block") <= F.col("y.block"))) & (differ <= distance)
        )
        same = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.block") == F.col("y.block"))
        rows = pairs.select(F.col("x.fps").alias("x"), F.when(~same, F.col("y.fps")).alias("y"))
        return saved(rows.mapInArrow(run, "src long, dst long"), "simhash-links")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint of each document and the smallest document that links reach.

    Only different fingerprints are indexed, so copies cost one row each. A null text counts as one without words: its
    fingerprint is 0 and links like any other. A null id is never the smallest; a component with no other ids has a null
    one. Repeated rows are returned each. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, ROWS):
        coded = saved(fingerprints(docs, words), "fingerprints")
    heads = saved(coded.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    grouped = heads.join(components(heads, distance), "fp")
    smallest = grouped.groupBy("component").agg(F.min("head").alias("component_id"))
    classes = grouped.join(smallest, "component").select("fp", "component_id")
    return coded.join(classes, "fp").select("doc_id", "fp", "component_id")


def components(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component) of different fingerprints: those that links reach have a component in common, one of its fingerprints."""
    edges = links(codes.select("fp"), distance)
    nodes = edges.select(F.col("src").alias("fp")).union(edges.select(F.col("dst").alias("fp"))).distinct()
    roots = connected_components(nodes, edges, "fp")
    return codes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
