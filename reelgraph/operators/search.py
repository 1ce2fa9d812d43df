"""Exact vector search, photo and video search cutoffs, ranks of known targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.operators import kernels as K

#: Fixed values of the search rules.
MIN_SCORE = 0.20
RELATIVE_CUTOFF = 0.88
MIN_RESULTS = 8
MIN_CANDIDATES = 40
POOL_TAU = 0.02

VIDEO_FRAMES = 65536  # a video with more frames is spread over several tasks


def knn(
    queries: DataFrame, vectors: DataFrame, k: int = 20, *, query_id: str = "query_id", id_col: str = "seq",
    vec: str = "embedding", broadcast_bytes: int | None = None, part_rows: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine per query, ties to the smallest id.

    Few queries are sent to every task, which keeps the k best of its rows; many are held in blocks while the vectors pass
    by in parts. Either way a task sends k rows per query, once. A score that is not a number is never among them.
    """
    parts = K.fold_scores(
        queries.select(F.col(query_id).cast("long").alias("_q"), F.col(vec)),
        vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec)),
        K.BestK(k), "query_id long, id long, score double", held_keys=["_q"], passed_keys=["_id"], send="held", vec=vec,
        broadcast_bytes=broadcast_bytes, part_rows=part_rows,
    )
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return parts.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def cutoff(scored: DataFrame, threshold: float = MIN_SCORE, limit: int | None = None) -> DataFrame:
    """Drop results far below the best of their query.

    Takes (query_id, id, score) and returns it with a 1-based rank. Nothing is kept when the best is below the
    threshold; otherwise rows from ``max(threshold, 0.88 * best)`` up stay, and so do the first eight above the
    threshold. Rows under the threshold can never stay, so they leave before the window.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = scored.filter(F.col("score") >= threshold).withColumns(
        {
            "rank": F.row_number().over(by_score),
            "_best": F.first("score").over(by_score),
        }
    )
    close = F.col("score") >= F.greatest(F.lit(threshold), F.col("_best") * RELATIVE_CUTOFF)
    kept = ranked.filter(close | (F.col("rank") <= MIN_RESULTS)).drop("_best")
    return kept if limit is None else kept.filter(F.col("rank") <= limit)


def photo_search(
    queries: DataFrame, vectors: DataFrame, *, limit: int = 40, threshold: float = MIN_SCORE,
    query_id: str = "query_id", id_col: str = "seq", vec: str = "embedding",
) -> DataFrame:
    """Text-to-photo search: the best ``max(limit, 40)`` candidates, cut off, first ``limit``."""
    found = knn(queries, vectors, max(limit, MIN_CANDIDATES), query_id=query_id, id_col=id_col, vec=vec)
    return cutoff(found.drop("rank"), threshold, limit)


def smooth_max_scores(
    queries: DataFrame, frames: DataFrame, *, tau: float = POOL_TAU, query_id: str = "query_id",
    video_id: str = "video_id", vec: str = "embedding", broadcast_bytes: int | None = None, part_rows: int | None = None,
    at_least: float | None = None,
) -> DataFrame:
    """(query_id, id, score) with ``tau * ln(mean(exp((s - max) / tau))) + max`` over the frames of a video.

    Tasks send (maximum, shifted sum, count) per query and video; the parts of a video are re-based on its overall
    maximum, so the exponential never overflows and a video of any length stays a handful of rows.

    ``at_least`` is for ``cutoff`` with that threshold: frames are placed by video, so most videos are scored whole in a
    task, and pairs that the cutoff cannot keep do not leave it. All others come with their score.
    """
    shots, kernel, cut_blocks, keys = frames.select(F.col(video_id).cast("long").alias("_video"), F.col(vec)), K.pooled_parts(tau), None, ["_video"]
    if at_least is not None:
        shots, keys = _by_video(shots, vec), ["_video", "_piece"]
        kernel, cut_blocks = K.pooled_parts(tau, at_least, RELATIVE_CUTOFF, MIN_RESULTS), K.group_blocks("_video", "_piece")
    parts = K.join_scores(
        queries.select(F.col(query_id).cast("long").alias("_q"), F.col(vec)), shots, kernel,
        "query_id long, video_id long, top double, mass double, n long", small_keys=["_q"], large_keys=keys, vec=vec,
        broadcast_bytes=broadcast_bytes, part_rows=part_rows, cut_blocks=cut_blocks,
    )
    video = Window.partitionBy("query_id", "video_id")
    based = parts.withColumn("_max", F.max("top").over(video))
    pooled = based.groupBy("query_id", F.col("video_id").alias("id")).agg(
        F.max("_max").alias("_m"),
        F.sum(F.col("mass") * F.exp((F.col("top") - F.col("_max")) / tau)).alias("_s"),
        F.sum("n").alias("_n"),
    )
    return pooled.select("query_id", "id", (F.lit(tau) * F.log(F.col("_s") / F.col("_n")) + F.col("_m")).alias("score"))


def _by_video(shots: DataFrame, vec: str) -> DataFrame:
    """Frames placed and sorted by video; ``_piece`` is 0, or from 1 on in a video that is too long for one task.

    Frames without a video belong to none and are left out.
    """
    shots = shots.filter(F.col("_video").isNotNull())
    long = shots.groupBy("_video").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(VIDEO_FRAMES))).alias("_pieces")).filter("_pieces > 1")
    # Frames of a long video are dealt by the task that read them too, so that its copies of one frame are spread.
    turn = F.pmod(F.xxhash64(vec, F.spark_partition_id()), F.col("_pieces")) + 1
    placed = shots.join(long, "_video", "left").withColumn("_piece", F.coalesce(turn, F.lit(0)).cast("long")).drop("_pieces")
    return placed.repartition("_video", "_piece").sortWithinPartitions("_video", "_piece")


def video_search(
    queries: DataFrame, frames: DataFrame, *, threshold: float = MIN_SCORE, query_id: str = "query_id",
    video_id: str = "video_id", vec: str = "embedding", broadcast_bytes: int | None = None, part_rows: int | None = None,
) -> DataFrame:
    """Text-to-video search over frame vectors: every video is scored, no limit and no candidate cap.

    Videos that cannot pass the cutoff are dropped by the task that scored them.
    """
    scored = smooth_max_scores(
        queries, frames, query_id=query_id, video_id=video_id, vec=vec, broadcast_bytes=broadcast_bytes, part_rows=part_rows,
        at_least=threshold,
    )
    return cutoff(scored, threshold)


def target_ranks(
    queries: DataFrame, vectors: DataFrame, *, query_id: str = "query_id", target: str = "target",
    id_col: str = "seq", vec: str = "embedding", broadcast_bytes: int | None = None, part_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank) of the one relevant item of each query.

    The rank is one plus the number of items ahead of the target, counted where the items are; no query ever has
    its full ranking materialised.
    """
    goal = vectors.select(F.col(id_col).cast("long").alias("_t"), F.col(vec).alias("_tv"))
    asked = queries.select(
        F.col(query_id).cast("long").alias("_q"), F.col(target).cast("long").alias("_t"), F.col(vec).cast("array<double>")
    ).join(goal, "_t")
    both = asked.select("_q", "_t", F.concat(vec, F.col("_tv").cast("array<double>")).alias(vec))
    parts = K.fold_scores(
        both, vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec)), K.AheadOfTarget(),
        "query_id long, ahead long", held_keys=["_q", "_t"], passed_keys=["_id"], send="held", vec=vec, normalise=False,
        broadcast_bytes=broadcast_bytes, part_rows=part_rows,
    )
    return parts.groupBy("query_id").agg((F.sum("ahead") + 1).alias("rank"))


def vector_by_path(vectors: DataFrame, path: str) -> DataFrame:
    """Point lookup; the filter reaches the parquet scan."""
    return vectors.filter(F.col("path") == path)


def known_paths(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paths that have a vector."""
    return paths.join(vectors.select("path"), "path", "left_semi")
