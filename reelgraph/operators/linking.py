"""Incremental linking one detection at a time, as exact as a sequential pass and dealt over independent groups.

A detection can only be linked through one that it resembles, or through a person whom the registry already knows. So
the groups of the graph of similar detections, joined where they match the same known person, do not touch each other:
each is passed through in order by itself, many of them in one task. A group that is too large for a task goes on in
heads of bounded size: a head is compared with what was settled before it by all tasks, and settled in one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.operators import kernels as K
from reelgraph.operators.clustering import component_edges, connected_components
from reelgraph.operators.identity import LINK_THRESHOLD, gated_detections, known_people
from reelgraph.operators.ranking import dense_ids
from reelgraph.session import cut

#: What a later batch has to know of an earlier one: its detections, the person of each, and whether it was stored.
SEEN = "det_id long, video_id long, person_id long, stored boolean, embedding array<double>"

#: A head that one task settles: it starts with ``task_rows`` and doubles up to so many rows.
HEAD_ROWS = 8192

_ROWS = "_id long, _video long, _v array<double>, _sim double, _who long, _new int, _taken boolean"
_DONE = "_id long, _video long, _v array<double>, _sim double, _who long, _new int, _stored boolean"


def _best_visible(heads, others):
    """Per row of the small side its best partner among those it can see: of all videos, or of its own."""
    (hcols, hmat), (ocols, omat) = heads, others
    order = np.lexsort((ocols["_who"], ocols["_o"], ocols["_new"]))
    columns, omat = {k: v[order] for k, v in ocols.items()}, omat[order]
    for part in K.tiles(len(hmat), len(omat)):
        s = K.similarities(hmat[part], omat)
        s[(columns["_own"][None, :] != 0) & (columns["_video"][None, :] != hcols["_hv"][part][:, None])] = -np.inf
        j = s.argmax(axis=1)
        top = s[np.arange(len(s)), j]
        ok = np.isfinite(top)
        found = {k: columns[k][j][ok] for k in ("_o", "_who", "_new")}
        yield {"_id": hcols["_h"][part][ok], "_sim": top[ok], **found}


def best_outside(rows: DataFrame, others: DataFrame, threshold: float, broadcast_bytes: int | None = None) -> DataFrame:
    """(_id, _sim, _who, _new): the best of ``others`` that each row sees, at the threshold or above.

    ``others`` has _o (its place among those of its kind), _video, _own (1 if only its video sees it), _who, _new and
    _v. Ties go to known people before new ones, then to the earliest.
    """
    parts = K.join_scores(
        rows.select(F.col("_id").alias("_h"), F.col("_video").alias("_hv"), "_v"), others, _best_visible,
        "_id long, _sim double, _o long, _who long, _new int", small_keys=["_h", "_hv"],
        large_keys=["_o", "_video", "_own", "_who", "_new"], vec="_v", broadcast_bytes=broadcast_bytes,
    )
    first = F.min(F.struct((-F.col("_sim")).alias("s"), "_new", "_o", "_who")).alias("b")
    best = parts.filter(F.col("_sim") >= threshold).groupBy("_id").agg(first)
    return best.select("_id", (-F.col("b.s")).alias("_sim"), F.col("b._who").alias("_who"), F.col("b._new").alias("_new"))


def _in_order(threshold: float):
    """Detections of independent groups in the order of their ids; rows marked as taken say who a video already has."""

    def settle(table: pa.Table) -> pa.Table:
        taken = table.column("_taken").to_numpy(zero_copy_only=False)
        had = table.filter(pa.array(taken))
        linked = set(zip(*(had.column(c).to_pylist() for c in ("_video", "_who", "_new")), strict=True))
        rows = table.filter(pa.array(~taken)).sort_by("_id")
        ids, videos = rows.column("_id").to_pylist(), rows.column("_video").to_numpy()
        x = K.unit(K.matrix(rows.column("_v")))
        outside = [rows.column(c).to_pylist() for c in ("_sim", "_who", "_new")]
        n = len(ids)
        person, stored, best = [None] * n, np.zeros(n, bool), [None] * n
        for i, (sim, who, new) in enumerate(zip(*outside, strict=True)):
            top, match = (-np.inf, None) if sim is None else (sim, (who, new))
            if i:
                s = np.round(x[:i] @ x[i], 12)
                s[~(stored[:i] | (videos[:i] == videos[i]))] = -np.inf
                j = int(s.argmax())
                if s[j] > top:
                    top, match = float(s[j]), person[j]
            if match is None or top < threshold:
                top, match = None, (ids[i], 1)
            person[i], best[i] = match, top
            key = (int(videos[i]), *match)
            stored[i] = key not in linked
            linked.add(key)
        return pa.table({
            "_id": rows.column("_id"), "_video": rows.column("_video"), "_v": rows.column("_v"), "_sim": pa.array(best, pa.float64()),
            "_who": pa.array([p[0] for p in person], pa.int64()), "_new": pa.array([p[1] for p in person], pa.int32()), "_stored": pa.array(stored),
        })

    return settle


def _groups(rows: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """(_id, component): detections that may depend on each other."""
    edges = component_edges(rows.select("_id", "_v"), threshold, id_col="_id", vec="_v")
    first = base.groupBy("_who", "_new").agg(F.min("_id").alias("src"))
    same = base.join(first, ["_who", "_new"]).filter("_id <> src").select("src", F.col("_id").alias("dst"))
    return cut(connected_components(rows.select("_id"), edges.select("src", "dst").unionByName(same), "_id"))


def _marks(taken: DataFrame, places: DataFrame) -> DataFrame:
    """Rows that tell each place (_place, _video) who its videos have already."""
    none = {"_id": "long", "_v": "array<double>", "_sim": "double"}
    marked = taken.join(places.distinct(), "_video").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return marked.withColumn("_taken", F.lit(True)).select("_place", *(c.split()[0] for c in _ROWS.split(", ")))


def _by_heads(rows: DataFrame, taken: DataFrame, threshold: float, task_rows: int, broadcast_bytes: int | None) -> DataFrame:
    """Settle ``rows`` in heads; what was settled before is compared with a head by all tasks.

    The first head has ``task_rows``, each next one twice as many up to ``HEAD_ROWS``, so that rounds do not grow with a
    small first head.
    """
    found: list[DataFrame] = []
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    after, size = None, task_rows
    while True:  # each round settles the next rows in order
        left = rows if after is None else rows.filter(F.col("_id") > after)
        last = left.select("_id").orderBy("_id").offset(size - 1).limit(1).first()
        head = left if last is None else left.filter(F.col("_id") <= last[0])
        had = taken
        if found:
            before = _union(found)
            had = had.unionByName(before.select("_video", "_who", "_new")).distinct()
            others = before.select(
                F.col("_id").alias("_o"), "_video", F.when(F.col("_stored"), 0).otherwise(1).alias("_own"), "_who", "_new", "_v"
            )
            better = best_outside(head, others, threshold, broadcast_bytes).toDF("_id", "_s", "_w", "_n")
            more = F.col("_s") > F.coalesce("_sim", F.lit(float("-inf")))
            head = head.join(better, "_id", "left").withColumns({
                c: F.when(more, F.col(b)).otherwise(F.col(c)) for c, b in (("_sim", "_s"), ("_who", "_w"), ("_new", "_n"))
            })
        head = head.select(F.lit(0).alias("_place"), *columns)
        every = head.unionByName(_marks(had, head.select("_place", "_video")))
        found.append(cut(every.groupBy("_place").applyInArrow(_in_order(threshold), _DONE)))
        if last is None:
            return _union(found)
        if len(found) > 32:
            found = [cut(_union(found))]
        after, size = last[0], max(task_rows, min(2 * size, HEAD_ROWS))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def link_faces_in_order(
    detections: DataFrame, faces: DataFrame, next_person_id: int, threshold: float = LINK_THRESHOLD, *,
    id_col: str = "det_id", seen: DataFrame | None = None, task_rows: int = 4096, broadcast_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link detections to people in the order of their ids: (linked, new_persons, seen).

    Each detection that passes the quality gate takes the person of the closest face it can see, at the threshold or
    above; else it becomes a person, numbered from ``next_person_id``. It sees the registry's faces, every earlier
    detection that was linked, and the earlier ones of its own video that were matched but not linked: a person is
    linked once in a video, by the first detection, and gains exemplars from the others while the video lasts. Ties go to
    the registry, there to the smallest person, then to the earliest detection.

    ``linked`` has the columns of ``detections``, person_id and sim (null for new people). The third result (``SEEN``) is
    what further batches of the same videos need: give all of it so far as ``seen``, with the linked faces in ``faces``,
    and batches give what one pass over all gives. Detections without a vector are left out. Ids must differ.
    """
    spark = detections.sparkSession
    good = cut(gated_detections(detections).filter(F.size("embedding") > 0).drop("person_id", "sim"))
    rows = good.select(
        F.col(id_col).cast("long").alias("_id"), F.col("video_id").cast("long").alias("_video"), F.col("embedding").cast("array<double>").alias("_v")
    )
    seen = spark.createDataFrame([], SEEN) if seen is None else seen
    seen = cut(seen.join(rows.select(F.col("_video").alias("video_id")).distinct(), "video_id", "left_semi"))
    known = known_people(faces).select(
        F.col("person_id").cast("long").alias("_o"), F.lit(0).cast("long").alias("_video"), F.lit(0).alias("_own"),
        F.col("person_id").cast("long").alias("_who"), F.col("embedding").cast("array<double>").alias("_v"),
    )
    # A batch before this one: what it linked is in the registry, the rest is seen by its own video.
    rest = seen.filter("not stored").select(
        F.col("person_id").alias("_o"), F.col("video_id").alias("_video"), F.lit(1).alias("_own"), F.col("person_id").alias("_who"),
        F.col("embedding").alias("_v"),
    )
    others = known.unionByName(rest).withColumn("_new", F.lit(0))
    base = cut(best_outside(rows, others, threshold, broadcast_bytes))
    n = rows.count()
    # What fits one task anyway is one group.
    grouped = _groups(rows, base, threshold) if n > task_rows else rows.select("_id", F.lit(0).cast("long").alias("component"))
    taken = seen.select(F.col("video_id").alias("_video"), F.col("person_id").alias("_who"), F.lit(0).alias("_new")).distinct()
    full = cut(rows.join(base, "_id", "left").join(grouped, "_id").withColumn("_taken", F.lit(False)))
    sizes = full.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.filter(F.col("_size") > task_rows)
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    # Small groups share tasks; groups do not touch, so a task goes through all of its own in one order.
    places = max(math.ceil(n / task_rows), spark.sparkContext.defaultParallelism if n > task_rows else 1)
    small = full.join(large, "component", "left_anti").withColumn("_place", F.pmod(F.xxhash64("component"), F.lit(places)).cast("int"))
    small = small.select("_place", *columns)
    every = small.unionByName(_marks(taken, small.select("_place", "_video")))
    done = [cut(every.groupBy("_place").applyInArrow(_in_order(threshold), _DONE))]
    if not large.isEmpty():
        rows_of_large = cut(full.join(large, "component", "left_semi").select(*columns))
        done.append(_by_heads(rows_of_large, taken, threshold, task_rows, broadcast_bytes))
    settled = cut(_union(done))
    fresh = cut(dense_ids(settled.filter("_new = 1 and _who = _id"), "_who", "_rank"))
    named = settled.join(fresh.withColumn("_new", F.lit(1)), ["_who", "_new"], "left").select(
        F.col("_id").alias(id_col), F.col("_video"), F.col("_v"), F.col("_sim").alias("sim"), F.col("_stored").alias("stored"),
        F.coalesce(F.col("_rank") + next_person_id, F.col("_who")).alias("person_id"),
    )
    named = cut(named)
    linked = good.join(named.filter("stored").select(id_col, "person_id", "sim"), id_col)
    new_persons = fresh.select((F.col("_rank") + next_person_id).alias("id"), F.lit(None).cast("string").alias("name"))
    now = named.select(
        F.col(id_col).cast("long").alias("det_id"), F.col("_video").alias("video_id"), "person_id", "stored", F.col("_v").alias("embedding")
    )
    return linked, new_persons, now
