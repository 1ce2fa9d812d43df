"""Frame tables: vectors per frame, frame sampling, keyframes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.functions.media import pick_evenly, sample_indices
from reelgraph.functions.vectors import as_double, histogram_correlation, l2_normalize
from reelgraph.session import cut

SAMPLED_FRAMES = 14
KEYFRAME_CORRELATION = 0.95
MIN_KEYFRAMES = 4
LOOK_AHEAD = 256  # frames compared with the last kept one at once


# ---------------------------------------------------------------- stored vectors


def vector_to_json(vec: Column | str) -> Column:
    return F.to_json(vec)


def vector_from_json(text: Column | str) -> Column:
    return F.from_json(text, "array<float>")


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def unpack_frames(blob: Column | str, width: int) -> Column:
    """float16 bytes -> list of frame vectors."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def unpack(blobs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False) // (2 * width)
        flat = np.frombuffer(b"".join(blobs.drop_null().to_pylist()), np.float16).astype(np.float32)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
        return pc.if_else(pc.is_null(blobs), None, pa.ListArray.from_arrays(pa.array(_ends(sizes)), rows))

    return unpack(blob)


@F.arrow_udf(T.BinaryType())
def _pack_half(vectors: pa.Array) -> pa.Array:
    rows = vectors.flatten()
    numbers = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float16).tobytes()
    upto = _ends(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
    ends = 2 * upto[_ends(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))]
    packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers)])
    return pc.if_else(pc.is_null(vectors), None, packed)


def pack_frames(vectors: Column | str) -> Column:
    """List of frame vectors -> float16 bytes."""
    return _pack_half(vectors)


def frame_rows(videos: DataFrame, width: int, *, blob: str = "frames", vec: str = "embedding") -> DataFrame:
    """(video_id, frame_idx, embedding): unit frame vectors, or the mean vector of a video that has none."""
    stored = F.when(F.length(blob) > 0, unpack_frames(blob, width)).otherwise(
        F.when(F.size(vec) > 0, F.array(F.col(vec).cast("array<float>")))
    )
    rows = videos.select(F.col("id").alias("video_id"), F.posexplode(stored).alias("frame_idx", "embedding"))
    return rows.withColumn("embedding", l2_normalize("embedding", eps=1e-9))


def pack_video_frames(frames: DataFrame) -> DataFrame:
    """(video_id, frames): float16 bytes per video, frames in order. A video holds at most a frame budget."""
    lists = frames.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", as_double("embedding").alias("v")))).alias("f")
    )
    return lists.select("video_id", pack_frames(F.transform("f", lambda x: x["v"])).alias("frames"))


# ---------------------------------------------------------------- sampling


def sampled_frames(
    frames: DataFrame, count: int = SAMPLED_FRAMES, *, total: str = "total_frames", keep: Column | None = None
) -> DataFrame:
    """The frames at ``count`` even positions of each video; ``total`` is the frame count on the row.

    Rows that meet ``keep`` stay in any case.
    """
    chosen = F.array_contains(sample_indices(F.col(total).cast("int"), F.lit(count)), F.col("frame_idx").cast("int"))
    return frames.filter(chosen if keep is None else keep | chosen)


def evenly_picked(frames: DataFrame, count: Column, *, total: str = "total_frames") -> DataFrame:
    """At most ``count`` frames of each video, evenly spread; ``frame_idx`` counts from 0 without gaps."""
    chosen = pick_evenly(F.col(total).cast("int"), count.cast("int"))
    return frames.filter(F.array_contains(chosen, F.col("frame_idx").cast("int")))


def spread_frames(frames: DataFrame, count: int = SAMPLED_FRAMES) -> DataFrame:
    """At most ``count`` evenly spread frames of each video, whatever their numbering; shorter videos keep all."""
    sizes = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("_at")) - 1
    placed = frames.select("video_id", F.col("frame_idx").alias("_at")).withColumn("frame_idx", place).join(sizes, "video_id")
    chosen = sampled_frames(placed, count, total="_n", keep=F.col("_n") <= count).select("video_id", F.col("_at").alias("frame_idx"))
    return frames.join(chosen, ["video_id", "frame_idx"], "left_semi")


# ---------------------------------------------------------------- keyframes


def correlations(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row with ``one``; 1.0 when either is constant."""
    n = rows.shape[1]
    total, own = rows.sum(1), one.sum()
    spread, own_spread = np.einsum("ij,ij->i", rows, rows) - total * total / n, one @ one - own * own / n
    flat = (spread <= 0) | (own_spread <= 0)
    return np.where(flat, 1.0, (rows @ one - total * own / n) / np.sqrt(np.where(flat, 1.0, spread * own_spread)))


def _fold_keyframes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of each video that correlate below the bound with the last kept one; rows come by video, in time order.

    A task holds a batch and one histogram, however long a video is.
    """
    video, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        videos = batch.column("video_id").to_pylist()
        hists = batch.column("h")
        rows = hists.flatten().to_numpy(zero_copy_only=False).reshape(len(videos), -1)
        kept, at = [], 0
        while at < len(videos):
            if last is None or videos[at] != video:
                video, last = videos[at], rows[at].copy()
                kept.append(at)
                at += 1
                continue
            end = at + 1
            while end < len(videos) and end < at + LOOK_AHEAD and videos[end] == video:
                end += 1
            new = np.flatnonzero(correlations(rows[at:end], last) < KEYFRAME_CORRELATION)
            if len(new):
                at += int(new[0])
                last = rows[at].copy()
                kept.append(at)
                at += 1
            else:
                at = end
        yield batch.take(pa.array(kept, pa.int64()))


def keyframes(frames: DataFrame, *, hist: str = "hist") -> DataFrame:
    """(video_id, frame_idx) of the frames that tell something new, whatever their number and numbering.

    In time order a frame stays when its histogram correlates below 0.95 with the last kept one. If fewer than four
    stay, the frames least correlated with any kept one fill up, ordered once; so videos of up to four frames keep all.
    Each video is one ordered fold; the rare fill-up joins the frames of these videos with their at most three kept ones.
    Take a sample first (``sampled_frames``) where a frame budget asks for one.
    """
    rows = frames.select("video_id", "frame_idx", as_double(hist).alias("h"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    kept = cut(ordered.mapInArrow(_fold_keyframes, schema))
    few = kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") < MIN_KEYFRAMES)
    have = kept.join(few, "video_id").select("video_id", "k", F.col("frame_idx").alias("_own"), F.col("h").alias("_k"))
    rest = rows.join(kept.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
    worst = rest.join(have, "video_id").groupBy("video_id", "frame_idx").agg(
        F.min(histogram_correlation("h", "_k")).alias("c"), F.first("k").alias("k")
    )
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("c", "frame_idx"))
    spare = worst.withColumn("r", place).filter(F.col("r") < MIN_KEYFRAMES).filter(F.col("r") <= MIN_KEYFRAMES - F.col("k"))
    return kept.select("video_id", "frame_idx").unionByName(spare.select("video_id", "frame_idx"))
