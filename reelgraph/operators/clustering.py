"""Identity clustering: connected components, greedy leaders, average linkage and the two-stage combination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.vectors import add, l2_normalize
from reelgraph.operators import kernels as K
from reelgraph.operators.pooling import pool_vectors
from reelgraph.operators.ranking import dense_ids
from reelgraph.session import cut

COMPONENT_THRESHOLD = 0.31
LEADER_THRESHOLD = 0.45
MERGE_THRESHOLD = 0.40
FIRST_ROUNDS = 3  # of linkage, which merge most clusters and are always searched by all tasks


def similar_pairs(
    df: DataFrame, threshold: float, *, id_col: str = "seq", vec: str = "embedding", strict: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """All pairs (src < dst, sim) at or above the threshold."""
    return K.self_join_scores(
        df, K.over_threshold(threshold, strict), "src long, dst long, sim double", id_col=id_col, vec=vec,
        block_rows=block_rows,
    )


# ---------------------------------------------------------------- connected components


def component_edges(
    df: DataFrame, threshold: float, *, id_col: str = "seq", vec: str = "embedding", block_rows: int | None = None
) -> DataFrame:
    """Edges (src < dst) with the same components as ``similar_pairs``, at most one per row and block pair."""
    return K.self_join_scores(
        df, K.spanning_stars(threshold), "src long, dst long", id_col=id_col, vec=vec, block_rows=block_rows
    )


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "seq") -> DataFrame:
    """(id, component) where the component is its smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step links the neighbours of a node to
    the smallest one, until every component is a star. Minima are pre-aggregated before the shuffle, and a hub is
    the skewed side of a plain equality join, which adaptive execution splits.
    """
    stars = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars = cut(stars.filter("u <> v").distinct())
    state = _fingerprint(stars)
    while True:
        stars = cut(_small_star(_large_star(stars)))
        previous, state = state, _fingerprint(stars)
        if previous == state:
            break
    roots = stars.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(id_col).join(roots, F.col(id_col) == F.col("u"), "left").select(
        id_col, F.coalesce("component", id_col).alias("component")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def similarity_components(
    df: DataFrame, threshold: float = COMPONENT_THRESHOLD, *, id_col: str = "seq", vec: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """Connected components of the graph of pairs with cosine at or above the threshold."""
    return connected_components(
        df, component_edges(df, threshold, id_col=id_col, vec=vec, block_rows=block_rows), id_col
    )


# ---------------------------------------------------------------- greedy leaders


def _resolve_head(threshold: float, strict: bool, keys: list[str]):
    """Leaders of one bounded head of the input order, taken in that order."""

    def leaders(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        rows = K.unit(K.matrix(table.column("_v")))
        covered = np.zeros(len(rows), bool)
        chosen = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            if covered[i]:
                continue
            chosen[i] = True
            s = np.round(rows[i + 1:] @ rows[i], 12)
            covered[i + 1:] |= s > threshold if strict else s >= threshold
        return table.select([*keys, "_id", "_v"]).append_column("_leader", pa.array(chosen))

    return leaders


def _uncovered(rows: np.ndarray, leaders: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    keep = np.ones(len(rows), bool)
    if len(leaders):
        for part in K.tiles(len(rows), len(leaders)):
            top = K.similarities(rows[part], leaders).max(axis=1)
            keep[part] = top <= threshold if strict else top < threshold
    return keep


def greedy_leaders(
    df: DataFrame, threshold: float, *, id_col: str = "seq", vec: str = "embedding", strict: bool = False,
    chunk_rows: int = 512, task_rows: int = 8192, max_chunk_rows: int = 1 << 20, broadcast_bytes: int | None = None,
) -> DataFrame:
    """Ids that a first-leader pass in id order would open a cluster for.

    An id is a leader unless an earlier leader reaches the threshold. Each round settles the next ``chunk_rows``
    open ids in order, a head that doubles up to ``max_chunk_rows``, then removes every later id that one of the new
    leaders covers, where the rows are and without a shuffle. A head of up to ``task_rows`` is walked in one task, a
    larger one is settled by all tasks. The arithmetic is rows x leaders, as in the sequential pass, and dense
    regions vanish as soon as their first leader is known.
    """
    pending = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    found: list[DataFrame] = []
    chunk = chunk_rows
    while True:  # each round settles the rows of its head
        last = pending.select("_id").orderBy("_id").offset(chunk - 1).limit(1).first()
        head = pending if last is None else pending.filter(F.col("_id") <= last[0])
        if chunk <= task_rows:
            settled = head.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(
                _resolve_head(threshold, strict, []), "_id long, _v array<double>, _leader boolean"
            )
            leaders = cut(settled.filter("_leader").select("_id", "_v"))
        else:
            leaders = _settle_head(head, threshold, strict, broadcast_bytes)
        found.append(leaders.select(F.col("_id").alias("leader")))
        if len(found) > 32:
            found = [cut(_union(found))]
        if last is None:
            return _union(found)
        later = pending.filter(F.col("_id") > last[0])
        pending = cut(without_covered(later, leaders, threshold, strict, broadcast_bytes))
        chunk = min(2 * chunk, max_chunk_rows)


def _settle_head(head: DataFrame, threshold: float, strict: bool, broadcast_bytes: int | None) -> DataFrame:
    """The leaders (_id, _v) of a large head, in rounds over all tasks.

    A row without an earlier open row in reach is a leader, whatever the others are; what it covers is settled, and the
    rest is the next round. The first open row always is one, so every round gets on.
    """
    open_rows, found = cut(head), []
    while True:
        earlier = K.join_scores(
            open_rows.select(F.col("_id").alias("_p"), "_v"), open_rows, K.earlier_in_reach(threshold, strict), "id long",
            small_keys=["_p"], large_keys=["_id"], vec="_v", broadcast_bytes=broadcast_bytes,
        )
        blocked = cut(earlier.select(F.col("id").alias("_id")).distinct())
        free = cut(open_rows.join(blocked, "_id", "left_anti"))
        found.append(free)
        left = without_covered(open_rows.join(blocked, "_id", "left_semi"), free, threshold, strict, broadcast_bytes)
        open_rows = cut(left)
        if open_rows.isEmpty():
            return cut(_union(found))


def without_covered(
    rows: DataFrame, leaders: DataFrame, threshold: float, strict: bool, broadcast_bytes: int | None = None
) -> DataFrame:
    """``rows`` (_id, _v) that no leader reaches, filtered where they are; many leaders are read in parts by each task."""
    n, width = K.shape(leaders, "_v")
    spark = rows.sparkSession
    if n * width * 8 <= (K.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        held = spark.sparkContext.broadcast(K.unit(K.matrix(leaders.toArrow().column("_v"))))

        def parts() -> Iterator[np.ndarray]:
            yield held.value
    else:
        count = max(1, -(-n // K.rows_per_block(width)))
        folder = K.parts_of(leaders, count, "_id")

        def parts() -> Iterator[np.ndarray]:
            for k in range(count):
                table = K.read_part(folder, k, ["_v"])
                if table is not None:
                    yield K.unit(K.matrix(table.column("_v")))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.blocks(batches, K.BLOCK_BYTES):
            for ahead in parts():
                if table.num_rows:
                    table = table.filter(pa.array(_uncovered(K.unit(K.matrix(table.column("_v"))), ahead, threshold, strict)))
            yield from table.to_batches()

    return rows.select("_id", "_v").mapInArrow(drop, "_id long, _v array<double>")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def greedy_leader_clusters(
    df: DataFrame, threshold: float = LEADER_THRESHOLD, *, id_col: str = "seq", vec: str = "embedding",
    chunk_rows: int = 512, task_rows: int = 8192, broadcast_bytes: int | None = None,
) -> DataFrame:
    """(id, leader): the nearest leader among those that came earlier, ties to the smallest; leaders lead themselves."""
    leaders = cut(greedy_leaders(
        df, threshold, id_col=id_col, vec=vec, chunk_rows=chunk_rows, task_rows=task_rows, broadcast_bytes=broadcast_bytes
    ))
    items = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_v"))
    ahead = items.join(leaders, F.col("_id") == F.col("leader"), "left_semi").withColumnRenamed("_id", "_p")
    behind = items.join(leaders, F.col("_id") == F.col("leader"), "left_anti")
    best = nearest_partner(ahead, behind, "earlier", vec="_v", broadcast_bytes=broadcast_bytes)
    joined = best.select(F.col("id").alias(id_col), F.col("partner").alias("leader"))
    return joined.unionByName(leaders.select(F.col("leader").alias(id_col), "leader"))


def nearest_partner(
    partners: DataFrame, rows: DataFrame, mode: str = "any", *, vec: str = "embedding", normalise: bool = True,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Per row (``_id``) the most similar partner (``_p``) as (id, partner, sim), ties to the smallest partner."""
    parts = K.fold_scores(
        rows, partners, K.BestOne(mode), "id long, partner long, sim double", held_keys=["_id"], passed_keys=["_p"],
        send="passed", vec=vec, normalise=normalise, broadcast_bytes=broadcast_bytes,
    )
    best = F.max(F.struct("sim", (-F.col("partner")).alias("back"))).alias("b")
    return parts.groupBy("id").agg(best).select("id", (-F.col("b.back")).alias("partner"), F.col("b.sim").alias("sim"))


def grouped_leaders(
    df: DataFrame, group: str, threshold: float, *, id_col: str = "id", vec: str = "embedding", strict: bool = False,
    chunk_rows: int = 1000, max_chunk_rows: int = 8192, large_rows: int = 1 << 20,
) -> DataFrame:
    """First-leader ids inside each group (a null group is one group).

    A round settles the first ``chunk_rows`` open ids of every group, a head that grows up to ``max_chunk_rows``, so
    groups of ordinary size are done after one round. Groups of more than ``large_rows`` are settled by ``greedy_leaders``. The rest of other groups is salted over as many tasks as its size asks for and the new leaders, a
    bounded number per group, are sent to each of them.
    """
    keyed = F.struct(F.col(group).isNull().alias("none"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("k"))
    pending = df.select(
        F.to_json(keyed).alias("_g"), F.col(id_col).cast("long").alias("_id"),
        F.col(vec).cast("array<double>").alias("_v"),
    )
    in_order = Window.partitionBy("_g").orderBy("_id")
    schema = "_g string, _id long, _v array<double>"
    found: list[DataFrame] = []
    # A group beyond ``large_rows`` (there are at most rows / large_rows) is a table of its own.
    large = [r[0] for r in pending.groupBy("_g").count().filter(F.col("count") > large_rows).select("_g").collect()]
    for g in large:
        own = pending.filter(F.col("_g") == g)
        found.append(greedy_leaders(own, threshold, id_col="_id", vec="_v", strict=strict))
    if large:
        pending = cut(pending.filter(~F.col("_g").isin(large)))
    while True:  # each round settles the heads of all open groups
        head = pending.withColumn("_rn", F.row_number().over(in_order)).filter(F.col("_rn") <= chunk_rows).drop("_rn")
        settled = cut(
            head.groupBy("_g").applyInArrow(_resolve_head(threshold, strict, ["_g"]), schema + ", _leader boolean")
        )
        leaders = settled.filter("_leader").drop("_leader")
        found.append(leaders.select(F.col("_id").alias("leader")))
        full = settled.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
        full = full.filter(F.col("_n") >= chunk_rows).drop("_n")
        rest = pending.join(full, "_g").filter(F.col("_id") > F.col("_last")).drop("_last")
        salts = rest.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(50_000.0)).cast("int").alias("_s"))
        left = rest.join(salts, "_g").withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_s")).cast("int")).drop("_s")
        right = leaders.join(salts, "_g").select(
            F.col("_g").alias("_h"), F.col("_v").alias("_w"), F.explode(F.expr("sequence(0, _s - 1)")).alias("_u")
        )

        def drop_covered(rows: pa.Table, ahead: pa.Table) -> pa.Table:
            rows_m, ahead_m = K.unit(K.matrix(rows.column("_v"))), K.unit(K.matrix(ahead.column("_w")))
            kept = rows.filter(pa.array(_uncovered(rows_m, ahead_m, threshold, strict))) if rows.num_rows else rows
            return kept.select(["_g", "_id", "_v"])

        pending = cut(left.groupBy("_g", "_t").cogroup(right.groupBy("_h", "_u")).applyInArrow(drop_covered, schema))
        if pending.isEmpty():
            return _union(found)
        if len(found) > 32:
            found = [cut(_union(found))]
        chunk_rows = min(2 * chunk_rows, max_chunk_rows)


# ---------------------------------------------------------------- average linkage


def _link_rest(threshold: float):
    """The rounds of ``average_linkage`` over the last clusters, in one task: (keep, gone), each with its final cluster."""

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        ids, v, n = table.column("_id").to_numpy(), K.matrix(table.column("_v")).copy(), table.column("_n").to_numpy().copy()
        root, at = np.arange(len(ids)), np.arange(len(ids))  # at: the clusters that are left
        while len(at) > 1:
            means = v[at] / n[at][:, None]
            s = K.similarities(means, means)
            s = np.maximum(s, s.T)  # rounding alone never leaves clusters without a mutual pair
            s[np.isnan(s)] = -np.inf
            np.fill_diagonal(s, -np.inf)
            best = s.argmax(axis=1)
            i = np.arange(len(at))
            near = s[i, best] > threshold
            keep = i[near & (best[best] == i) & (i < best)]
            gone = best[keep]
            if not len(keep):
                break
            v[at[keep]] += v[at[gone]]
            n[at[keep]] += n[at[gone]]
            root[at[gone]] = at[keep]
            near[gone] = False
            at = at[near]
        while not np.array_equal(root, root[root]):
            root = root[root]
        moved = root != np.arange(len(ids))
        return pa.table({"keep": pa.array(ids[root[moved]], pa.int64()), "gone": pa.array(ids[moved], pa.int64())})

    return link


def average_linkage(
    df: DataFrame, threshold: float | None = MERGE_THRESHOLD, *, id_col: str = "cluster", vec: str = "embedding",
    broadcast_bytes: int | None = None, task_rows: int = 2048,
) -> DataFrame:
    """(id, merged): average-linkage clusters of unit vectors, cut where the average cosine is not above ``threshold``.

    For unit vectors the average pairwise cosine of two clusters is the inner product of their unnormalised means,
    so a cluster is a (sum, count) row. Average linkage is reducible: merging all reciprocal nearest neighbours of a
    round gives the same tree as one merge at a time (Murtagh, 1983), and a cluster whose best partner is not above
    the threshold never gets one and leaves the work.

    For the same reason a merger never comes closer to a cluster than the nearer of its two parts was. So a nearest partner
    is kept until it or the cluster itself merges, and only the others are searched again.

    The first rounds merge most clusters; the last ones merge a few each and are many. When no more than ``task_rows``
    clusters are left after ``FIRST_ROUNDS``, one task goes through the remaining rounds.
    """
    unit = df.select(F.col(id_col).cast("long").alias("_id"), l2_normalize(vec).alias("_v"))
    same = unit.select(F.col("_id").alias(id_col), F.col("_id").alias("merged"))
    if threshold is None:
        return same
    # Exact copies are merged first in any order, so they start as one cluster and cost no rounds.
    unit = cut(unit)
    copies = cut(unit.filter(F.exists("_v", lambda x: x != 0)).groupBy("_v").agg(
        F.min("_id").alias("_keep"), F.count(F.lit(1)).cast("double").alias("_n")
    ))
    alone = unit.filter(~F.exists("_v", lambda x: x != 0)).select("_id", "_v", F.lit(1.0).alias("_n"))
    active = cut(copies.select(
        F.col("_keep").alias("_id"), F.transform("_v", lambda x: x * F.col("_n")).alias("_v"), "_n"
    ).unionByName(alone))
    same = unit.join(copies, "_v", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_keep", "_id").alias("merged")
    )
    mapping, waiting = cut(same), []
    rounds, near, stale = 0, None, None  # near: the nearest partners that still hold; stale: the clusters to search again, None for all
    while True:  # each round merges at least the closest pair
        if rounds >= FIRST_ROUNDS and active.count() <= task_rows:
            last = active.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(_link_rest(threshold), "keep long, gone long")
            return _follow(mapping, [*waiting, cut(last)], id_col)
        rounds += 1
        means = active.select("_id", F.transform("_v", lambda x: x / F.col("_n")).alias("_v"))
        found = nearest_partner(
            means.withColumnRenamed("_id", "_p"), means if stale is None else means.join(stale, "_id", "left_semi"), "other",
            vec="_v", normalise=False, broadcast_bytes=broadcast_bytes,
        )
        found = found.filter(F.col("sim") > threshold).select("id", "partner")
        near = cut(found if stale is None else near.unionByName(found))
        back = near.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        merges = cut(near.join(back, ["id", "partner"]).filter("id < partner").toDF("keep", "gone"))
        if merges.isEmpty():
            if stale is None or near.isEmpty():
                return _follow(mapping, waiting, id_col)
            stale = None  # rounding alone can leave no mutual pair among kept partners
            continue
        gone = active.select(F.col("_id").alias("gone"), F.col("_v").alias("_w"), F.col("_n").alias("_m"))
        grown = (
            active.join(near.select(F.col("id").alias("_id")), "_id", "left_semi")
            .join(merges.select(F.col("gone").alias("_id")), "_id", "left_anti")
            .join(merges.join(gone, "gone"), F.col("_id") == F.col("keep"), "left")
        )
        active = cut(
            grown.select(
                "_id",
                F.when(F.col("gone").isNull(), F.col("_v")).otherwise(add("_v", "_w")).alias("_v"),
                (F.col("_n") + F.coalesce("_m", F.lit(0.0))).alias("_n"),
            )
        )
        changed = merges.select(F.col("keep").alias("_id")).unionByName(merges.select(F.col("gone").alias("_id")))
        lost = near.join(changed.withColumnRenamed("_id", "partner"), "partner", "left_semi").select(F.col("id").alias("_id"))
        stale = cut(lost.unionByName(changed).distinct())
        near = near.join(stale.withColumnRenamed("_id", "id"), "id", "left_anti")
        waiting.append(merges)
        if len(waiting) == 8:
            mapping, waiting = cut(_follow(mapping, waiting, id_col)), []


def _follow(mapping: DataFrame, merges: list[DataFrame], id_col: str) -> DataFrame:
    """``mapping`` after some rounds of merges, oldest first."""
    for step in merges:
        mapping = mapping.join(step, F.col("merged") == F.col("gone"), "left").select(
            id_col, F.coalesce("keep", "merged").alias("merged")
        )
    return mapping


# ---------------------------------------------------------------- two-stage clustering


def mark_small_clusters(df: DataFrame, min_cluster_size: int, label: str = "label", id_col: str = "seq") -> DataFrame:
    """Rows of clusters below ``min_cluster_size`` get the label -1. Sizes are counted before the join back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    kept = F.when(F.col("_size") >= min_cluster_size, F.col(label)).otherwise(F.lit(-1))
    return df.join(sizes, label).withColumn(label, kept).drop("_size")


def two_stage_clusters(
    df: DataFrame, *, min_cluster_size: int = 3, threshold: float = LEADER_THRESHOLD,
    merge_threshold: float | None = MERGE_THRESHOLD, id_col: str = "seq", vec: str = "embedding",
    chunk_rows: int = 512,
) -> DataFrame:
    """(id, label): strict greedy leaders, then an average-linkage merge of their centroids.

    Labels count from 0 in the order of the smallest member; clusters below ``min_cluster_size`` are -1.
    """
    unit = df.select(F.col(id_col).cast("long").alias("seq"), l2_normalize(vec).alias("embedding"))
    led = cut(greedy_leader_clusters(unit, threshold, chunk_rows=chunk_rows))
    centroids = pool_vectors(unit.join(led, "seq"), ["leader"], how="sum", eps=1e-9)
    merged = average_linkage(centroids, merge_threshold, id_col="leader")
    grouped = cut(led.join(merged, "leader").select("seq", F.col("merged").alias("cluster")))
    labelled = grouped.join(dense_ids(grouped, "cluster", "label"), "cluster").select("seq", "label")
    sized = mark_small_clusters(labelled, max(1, min_cluster_size))
    return sized.select(F.col("seq").alias(id_col), F.col("label").cast("long").alias("label"))


def cluster_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of clusters, noise (-1) left out."""
    return df.filter(F.col(label) != -1).agg(F.countDistinct(label).alias("clusters"))


def threshold_sweep(
    df: DataFrame, thresholds: list[float], *, id_col: str = "seq", vec: str = "embedding", min_cluster_size: int = 1,
    merge_threshold: float | None = MERGE_THRESHOLD,
) -> DataFrame:
    """Clusters found per leader threshold by the two-stage clustering; the list of thresholds is the tuner's input."""
    counts = [
        cluster_count(
            two_stage_clusters(
                df, min_cluster_size=min_cluster_size, threshold=t, merge_threshold=merge_threshold, id_col=id_col,
                vec=vec,
            )
        ).select(F.lit(float(t)).alias("threshold"), "clusters")
        for t in thresholds
    ]
    return _union(counts)
