"""End-to-end flows put together from operators: text search, a photo indexing pass, video analysis."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.text import PLACEHOLDER_LABEL, basename, clean_queries, expand_queries
from reelgraph.operators import identity as I
from reelgraph.operators.linking import link_faces_in_order
from reelgraph.operators import labeling as L
from reelgraph.operators import library as LB
from reelgraph.operators import registry as R
from reelgraph.operators import search as S
from reelgraph.operators.frames import keyframes, pack_video_frames, spread_frames
from reelgraph.operators.pooling import pool_vectors
from reelgraph.operators.ranking import with_row_number
from reelgraph.session import cut
from reelgraph.sources import encoders as EN
from reelgraph.sources import files as SF
from reelgraph.sources.vector_table import as_stored
from reelgraph.streaming.ingest import remember_empty

Factory = Callable[[], EN.Encoder]


# ---------------------------------------------------------------- search


def search_photos(queries: DataFrame, vectors: DataFrame, texts: Factory, **options) -> DataFrame:
    """(query_id, text) -> ranked photos; any number of queries in one job."""
    prompts = EN.valid_vectors(EN.embed_prompts(expand_queries(queries), texts))
    return S.photo_search(cut(EN.query_vectors(prompts)), vectors, **options)


def search_videos(queries: DataFrame, frames: DataFrame, texts: Factory, **options) -> DataFrame:
    """(query_id, text) -> ranked videos."""
    vectors = EN.caption_query_vectors(clean_queries(queries), texts)
    return S.video_search(cut(vectors), frames, **options)


def search_everything(
    queries: DataFrame, photo_vectors: DataFrame, frames: DataFrame, texts: Factory, kind: str = "all"
) -> DataFrame:
    """Photo and video results of each query by falling score."""
    return LB.merged_results(
        search_photos(queries, photo_vectors, texts), search_videos(queries, frames, texts), kind
    )


# ---------------------------------------------------------------- photos


@dataclass(frozen=True)
class PhotoTables:
    """What an indexing pass reads and what it returns, to be written by the caller."""

    face_vectors: DataFrame
    semantic_vectors: DataFrame
    scanned_empty: DataFrame
    people: DataFrame
    person_photos: DataFrame


def _append(table: DataFrame, found: DataFrame, kind: str, model_id: str) -> DataFrame:
    """New vectors numbered after the stored ones, in path order."""
    last = table.agg(F.coalesce(F.max("seq") + 1, F.lit(0)))
    numbered = with_row_number(found, "path", name="_n").withColumn("seq", last.scalar() + F.col("_n") - 1)
    return table.unionByName(as_stored(numbered, kind, model_id))


def index_photos(
    tables: PhotoTables, photos: DataFrame, detect: Callable[[DataFrame], DataFrame], images: Factory, model_id: str,
    **clustering,
) -> PhotoTables:
    """One indexing pass over ``photos`` (path, modification_time, length, content).

    Time-stamped duplicates of photos that are there are left out, rows of removed files go, new files are scanned for
    faces and embedded, and people are rebuilt when the faces changed. ``detect`` maps new photos to detections (path, det_ord, x1, y1, x2, y2, embedding); photos without one
    are remembered by signature.
    """
    copies = R.duplicate_files(photos).filter("action = 'remove'").select(F.col("name").alias("_name"))
    photos = photos.withColumn("_name", basename(F.col("path"))).join(copies, "_name", "left_anti").drop("_name")
    signatures = SF.file_signatures(photos)
    faces = R.live_rows(tables.face_vectors, photos)
    # Vectors of another model are dropped and their files embedded again, so an index never mixes two spaces.
    semantic, _ = R.split_by_model(R.live_rows(tables.semantic_vectors, photos), model_id)
    semantic = cut(semantic)
    new = R.unscanned(signatures, faces, tables.scanned_empty)
    largest = cut(SF.largest_faces(detect(photos.join(new.select("path"), "path", "left_semi"))))
    empty = new.join(largest.select("path"), "path", "left_anti")
    cache = remember_empty(tables.scanned_empty, photos, faces, empty)
    found = EN.valid_vectors(EN.embed_photos(R.unindexed(photos, semantic), images))
    all_faces = cut(_append(faces, largest, "face", model_id))
    new_semantic = _append(semantic, cut(found), "semantic", model_id)
    removed = R.unindexed(tables.face_vectors, photos)
    if largest.isEmpty() and removed.isEmpty() and not tables.people.isEmpty():
        people, person_photos = tables.people, tables.person_photos
    else:
        people, person_photos = I.rebuild_photo_people(all_faces, **clustering)
    return PhotoTables(all_faces, new_semantic, cache, people, person_photos)


# ---------------------------------------------------------------- videos


def analyse_videos(
    videos: DataFrame, frames: DataFrame, images: Factory, label_vectors: DataFrame, feedback: DataFrame | None = None
) -> DataFrame:
    """(id, label, embedding, frames) of the videos in ``frames`` (video_id, frame_idx, hist, content).

    At most 14 evenly spread frames of a video are looked at; its keyframes are encoded, pooled to one vector and
    labelled. The result goes to ``registry.update_vectors``.
    """
    frames = spread_frames(frames)
    kept = frames.join(keyframes(frames), ["video_id", "frame_idx"], "left_semi")
    keyed = kept.select(F.struct("video_id", "frame_idx").alias("frame"), "content")
    text_key = keyed.select(F.to_json("frame").alias("frame"), "content")
    encoded = EN.valid_vectors(EN.embed(text_key, "frame", "content", images))
    parsed = F.from_json("frame", "video_id long, frame_idx int")
    vectors = cut(encoded.select(parsed.alias("f"), "embedding").select("f.video_id", "f.frame_idx", "embedding"))
    pooled = cut(pool_vectors(vectors, ["video_id"]).withColumnRenamed("video_id", "id"))
    labels = L.classify(pooled, label_vectors, feedback).withColumnRenamed("item_id", "id")
    packed = pack_video_frames(vectors).withColumnRenamed("video_id", "id")
    known = videos.select("id")
    return pooled.join(known, "id", "left_semi").join(labels, "id").join(packed, "id").select(
        "id", "label", "embedding", "frames"
    )


@dataclass(frozen=True)
class VideoTables:
    """The video registry, as a pass reads and returns it."""

    videos: DataFrame
    faces: DataFrame
    persons: DataFrame
    meta: DataFrame


def index_videos(
    tables: VideoTables, files: DataFrame, thumbnails: DataFrame, frames: DataFrame, detections: DataFrame, images: Factory,
    label_vectors: DataFrame, feedback: DataFrame | None = None,
) -> VideoTables:
    """One pass over the video folder: reconcile, analyse what is new or incomplete, link its faces, rebuild people once.

    ``frames`` (file_name, frame_idx, hist, content) and ``detections`` (file_name and the columns of DETECTIONS without
    video_id) come from the files to analyse. People are rebuilt at the end, when all videos of the pass are in.
    """
    actions = cut(R.reconcile_videos(tables.videos, files, thumbnails))
    videos, faces, persons = R.apply_reconciliation(actions, tables.videos, tables.faces, tables.persons)
    added = actions.filter("action = 'add'").select(
        F.col("new_path").alias("path"), F.lit(PLACEHOLDER_LABEL).alias("label"), F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(None).cast("binary").alias("frames"),
    )
    videos, faces, persons = (cut(x) for x in R.upsert_videos(videos, added, faces, persons, tables.meta))
    meta = cut(R.with_last_id(tables.meta, videos))
    todo = actions.filter("action in ('add', 'requeue')").select("file_name")
    ids = cut(videos.select(F.col("id").alias("video_id"), basename(F.col("path")).alias("file_name")).join(todo, "file_name", "left_semi"))
    results = cut(analyse_videos(videos, frames.join(ids, "file_name"), images, label_vectors, feedback))
    videos = cut(R.update_vectors(videos, results))
    faces = faces.join(ids.select("video_id"), "video_id", "left_anti").select(*faces.columns)
    next_person = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    next_face = faces.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    linked, fresh, _ = link_faces_in_order(detections.join(ids, "file_name"), faces, next_person)
    numbered = with_row_number(cut(linked), "det_id", name="_n")
    new_faces = numbered.select(
        (F.lit(next_face) + F.col("_n")).alias("id"), "video_id", "person_id", "embedding",
        F.lit(None).cast("string").alias("thumbnail_path"), F.col("det_score").alias("confidence"), F.col("yaw").alias("pose_yaw"),
    )
    every = cut(R.add_face(faces, new_faces).select(*faces.columns))
    people = persons.unionByName(fresh, allowMissingColumns=True)
    new_persons, rebuilt = I.rebuild_video_people(every, people)
    return VideoTables(videos, cut(rebuilt), cut(new_persons), meta)
