"""Registry maintenance: old tables in, new tables out. Writing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.media import cleanup_reason
from reelgraph.functions.text import PLACEHOLDER_LABEL, basename, original_name, stem
from reelgraph.operators.library import first_per_key
from reelgraph.operators.ranking import with_row_number

LAST_ID = "last_video_id"
STRETCH_ROWS = 1 << 16  # rows in a row that a join takes as one key
#: Fixed value: the model of vectors that were stored without one.
LEGACY_MODEL_ID = "clip-vit-b32-int8"  # model of vectors that carry no record


# ---------------------------------------------------------------- joins over faces, persons and videos


def faces_with_names(faces: DataFrame, persons: DataFrame) -> DataFrame:
    return faces.join(persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left")


def face_gallery(faces: DataFrame, videos: DataFrame) -> DataFrame:
    """(person_id, thumbnail, confidence, video): gallery entries, one row each, keyed by person.

    Rows instead of one nested list per person: a person may own any share of the faces.
    """
    clips = videos.select(F.col("id").alias("video_id"), basename(F.col("path")).alias("video"))
    return faces.join(clips, "video_id").select(
        F.col("person_id").cast("string").alias("person_id"), F.col("thumbnail_path").alias("thumbnail"), "confidence",
        "video",
    )


def nested_gallery(faces: DataFrame, videos: DataFrame, chunk: int = 1000) -> DataFrame:
    """(person_id, chunk, faces): the gallery as lists of structs, each of at most ``chunk`` faces of one person.

    Faces are numbered over the whole table, so a person with a third of all faces is many short lists.
    """
    clips = videos.select(F.col("id").alias("video_id"), basename(F.col("path")).alias("video"))
    rows = faces.join(clips, "video_id").select(
        F.coalesce(F.col("person_id").cast("string"), F.lit("None")).alias("person_id"), "id",
        F.col("thumbnail_path").alias("thumbnail"), "confidence", "video",
    )
    stretch = F.floor(F.col("_rn") / STRETCH_ROWS).cast("long")
    placed = with_row_number(rows, "person_id", "id", name="_rn").withColumn("_stretch", stretch)
    # Per stretch of rows, so that a person with many faces is not one key of the join.
    starts = placed.groupBy("person_id", "_stretch").agg(F.min("_rn").alias("_rn")).select(
        "person_id", "_stretch", F.min("_rn").over(Window.partitionBy("person_id")).alias("_first")
    )
    part = F.floor((F.col("_rn") - F.col("_first")) / chunk).cast("long")
    return placed.join(starts, ["person_id", "_stretch"]).groupBy("person_id", part.alias("chunk")).agg(
        F.collect_list(F.struct("thumbnail", "confidence", "video")).alias("faces")
    )


def face_counts(faces: DataFrame) -> DataFrame:
    return faces.groupBy("person_id").agg(F.count("id").alias("n"))


def persons_with_faces(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Persons that have faces, with their number, by id. Faces are counted before the join."""
    counted = face_counts(faces).withColumnRenamed("person_id", "id")
    return persons.join(counted, "id").select("id", "name", "thumbnail", "n").orderBy("id")


def face_distribution(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, n) for every person, zero included."""
    counted = face_counts(faces).withColumnRenamed("person_id", "id")
    return persons.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def person_videos(person_id: int, faces: DataFrame, videos: DataFrame) -> DataFrame:
    """Distinct (path, label) of the videos a person appears in."""
    seen = faces.filter(F.col("person_id") == person_id).select(F.col("video_id").alias("id"))
    return videos.join(seen, "id", "left_semi").select("path", "label").distinct()


# ---------------------------------------------------------------- incremental candidates


def unindexed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    return files.join(indexed.select("path"), "path", "left_anti")


def unscanned(files: DataFrame, indexed: DataFrame, scanned_empty: DataFrame) -> DataFrame:
    """Files without a vector whose (mtime_ns, size) is not remembered as empty."""
    key = ["path", "mtime_ns", "size"]
    return unindexed(files, indexed).join(scanned_empty.select(*key), key, "left_anti")


def indexed_labels(files: DataFrame, videos: DataFrame, upload_dir: str = "uploaded_videos") -> DataFrame:
    """``files`` (path) with the label of the registry row that already covers them, and whether one does.

    A file counts as indexed under its destination path, its .mp4 twin or its own path.
    """
    rows = first_per_key(videos.select("path", "label", "id"), "path", -F.col("id")).select("path", "label")
    destination = F.concat(F.lit(upload_dir + "/"), basename(F.col("path")))
    twin = F.concat(F.lit(upload_dir + "/"), stem(F.col("path")), F.lit(".mp4"))
    keyed = files.withColumns({"_k1": destination, "_k2": twin, "_k3": F.col("path")})
    for i in (1, 2, 3):
        side = rows.select(F.col("path").alias(f"_k{i}"), F.col("label").alias(f"_l{i}"), F.lit(True).alias(f"_h{i}"))
        keyed = keyed.join(side, f"_k{i}", "left")
    hit = F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False)) | F.coalesce("_h3", F.lit(False))
    by_place = F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False))
    first = F.coalesce(F.when(F.col("_l1") != "", F.col("_l1")), F.when(F.col("_h2"), F.col("_l2")), F.col("_l1"))
    return keyed.select(*files.columns, F.when(by_place, first).otherwise(F.col("_l3")).alias("label"), hit.alias("indexed"))


# ---------------------------------------------------------------- repeated keys


def last_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: that with the greatest ``order``, or without one the greatest by all columns."""
    rest = [c for c in df.columns if c != key]
    whole = F.struct(*rest)
    best = F.max(whole) if order is None else F.max_by(whole, F.struct(order, *[c for c in rest if c != order]))
    return df.groupBy(key).agg(best.alias("_last")).select(*[F.col(key) if c == key else F.col(f"_last.{c}") for c in df.columns])


# ---------------------------------------------------------------- reconcile with files


def reconcile_videos(videos: DataFrame, files: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """(id, file_name, old_path, new_path, action) from one outer join on the file name.

    Actions: delete (no file), add (no row), requeue (no vector, placeholder or unknown label, no thumbnail), repoint
    (file elsewhere) and keep. A row to requeue is repointed as well when its path differs.
    """
    rows = videos.select(
        "id", F.col("path").alias("old_path"), basename(F.col("path")).alias("file_name"), "label",
        F.col("embedding").isNotNull().alias("_has_vector"),
    )
    # One path of each name: the row's own where it is among the files, else the smallest.
    named = files.select("path", basename(F.col("path")).alias("file_name"))
    own = rows.select(F.col("old_path").alias("path")).distinct().withColumn("_own", F.lit(True))
    disk = named.join(own, "path", "left").groupBy("file_name").agg(
        F.min("path").alias("_least"), F.collect_set(F.when(F.col("_own"), F.col("path"))).alias("_owned")
    )
    thumbs = thumbnails.select(stem(F.col("path")).alias("_stem"), F.lit(True).alias("_thumb")).distinct()
    stays = F.coalesce(F.array_contains("_owned", F.col("old_path")), F.lit(False))
    paired = rows.join(disk, "file_name", "full_outer").withColumn(
        "new_path", F.when(stays, F.col("old_path")).otherwise(F.col("_least"))
    )
    both = paired.withColumn("_stem", stem(F.col("file_name"))).join(thumbs, "_stem", "left")
    incomplete = (
        ~F.col("_has_vector")
        | F.coalesce(F.col("label").isin(PLACEHOLDER_LABEL, "unknown"), F.lit(False))
        | F.col("_thumb").isNull()
    )
    action = (
        F.when(F.col("new_path").isNull(), F.lit("delete"))
        .when(F.col("id").isNull(), F.lit("add"))
        .when(incomplete, F.lit("requeue"))
        .when(F.col("old_path") != F.col("new_path"), F.lit("repoint"))
        .otherwise(F.lit("keep"))
    )
    return both.select("id", "file_name", "old_path", "new_path", action.alias("action"))


def apply_reconciliation(
    actions: DataFrame, videos: DataFrame, faces: DataFrame, persons: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, faces, persons) after deletes and repoints; new files are inserted by ``upsert_video``."""
    gone = actions.filter("action = 'delete'").select("id")
    moved = actions.filter("id is not null and new_path is not null").select("id", "new_path")
    kept = without_ids(videos, gone).join(moved, "id", "left")
    new_videos = kept.withColumn("path", F.coalesce("new_path", "path")).select(*videos.columns)
    new_faces = faces.join(gone.withColumnRenamed("id", "video_id"), "video_id", "left_anti").select(*faces.columns)
    return new_videos, new_faces, without_orphans(persons, new_faces)


def live_rows(table: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """Rows of a manifest, vector or people table whose file still exists."""
    return table.join(live.select(F.col("path").alias(key)), key, "left_semi").select(*table.columns)


def reconcile_photos(
    manifest: DataFrame, vectors: DataFrame, people: DataFrame, person_photos: DataFrame, live: DataFrame
) -> dict[str, DataFrame]:
    """Manifest (first of each path), vectors, person photos and people without dead paths."""
    photos = first_per_key(
        live_rows(person_photos, live), F.concat_ws("\u0001", "person_id", "path"), "seq"
    )
    return {
        "manifest": first_per_key(live_rows(manifest, live), "path", "seq"),
        "vectors": live_rows(vectors, live),
        "person_photos": photos,
        "people": people.join(photos.select("person_id"), "person_id", "left_semi"),
    }


def duplicate_files(files: DataFrame) -> DataFrame:
    """(name, original, action) of timestamped duplicates: remove when the original is there, else rename.

    Several duplicates of an absent original: the smallest name takes its place and the others are removed.
    """
    named = files.select(basename(F.col("path")).alias("name"))
    dups = named.withColumn("original", original_name(F.col("name"))).filter(F.col("original").isNotNull())
    present = named.select(F.col("name").alias("original"), F.lit(True).alias("_present")).distinct()
    heir = dups.groupBy("original").agg(F.min("name").alias("_heir"))
    removed = F.coalesce(F.col("_present"), F.lit(False)) | (F.col("name") != F.col("_heir"))
    return dups.join(present, "original", "left").join(heir, "original").select(
        "name", "original", F.when(removed, F.lit("remove")).otherwise(F.lit("rename")).alias("action")
    )


def without_orphans(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Persons that still have a face."""
    used = faces.filter(F.col("person_id").isNotNull()).select(F.col("person_id").alias("id"))
    return persons.join(used, "id", "left_semi")


def without_ids(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("id"), "id", "left_anti")


def deletion_targets(videos: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct video (id, path) named by ``targets`` (target): an id, a numeric text, a path or a file name."""
    numeric = F.col("target").rlike(r"^\d+$")
    ids = targets.filter(numeric).select(F.col("target").cast("long").alias("id"))
    names = targets.filter(~numeric).select(basename(F.col("target")).alias("_name"))
    rows = videos.select("id", "path")
    by_id = rows.join(ids, "id", "left_semi")
    by_name = rows.withColumn("_name", basename(F.col("path"))).join(names, "_name", "left_semi").select("id", "path")
    return by_id.union(by_name).distinct()


def zip_by_position(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    """Vectors and paths with the same ``seq``; a position that only one side has, or has twice, is an error."""
    sides = vectors.select("seq", F.lit(1).alias("v"), F.lit(0).alias("p")).unionByName(
        paths.select("seq", F.lit(0).alias("v"), F.lit(1).alias("p"))
    )
    wrong = sides.groupBy("seq").agg(F.sum("v").alias("v"), F.sum("p").alias("p")).filter("v <> 1 or p <> 1")
    bad = wrong.agg(F.count(F.lit(1)), F.min("seq")).first()
    if bad[0]:
        raise ValueError(f"{bad[0]} positions without one vector and one path each, the first {bad[1]}")
    return paths.join(vectors, "seq")


# ---------------------------------------------------------------- counts


def global_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    return rows.agg(*[F.max(F.when(F.col("t") == name, F.col("n"))).alias(name) for name in tables])


def faces_per_video(faces: DataFrame) -> DataFrame:
    return faces.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(faces: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of the confidences; the plain list is ``faces.select("confidence")``."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long")
    return faces.filter(F.col("confidence").isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(videos: DataFrame) -> DataFrame:
    """(rows, max_id, frame_chars, label_chars): equal fingerprints mean unchanged search data."""
    frame_size = F.length("frames") if "frames" in videos.columns else F.lit(0)
    return videos.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
        F.coalesce(F.sum(frame_size), F.lit(0)).alias("frame_chars"),
        F.coalesce(F.sum(F.length("label")), F.lit(0)).alias("label_chars"),
    )


# ---------------------------------------------------------------- videos


def deduplicate_videos(
    videos: DataFrame, faces: DataFrame, persons: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, faces, persons): the lowest id of each file name stays, with its faces and their persons."""
    keep = videos.groupBy(basename(F.col("path")).alias("_name")).agg(F.min("id").alias("id")).select("id")
    gone = videos.select("id").join(keep, "id", "left_anti")
    new_faces = faces.join(gone.withColumnRenamed("id", "video_id"), "video_id", "left_anti").select(*faces.columns)
    return videos.join(keep, "id", "left_semi"), new_faces, without_orphans(persons, new_faces)


def upsert_videos(
    videos: DataFrame, incoming: DataFrame, faces: DataFrame, persons: DataFrame, meta: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert or update by file name: (videos, faces, persons).

    ``incoming`` (path, label, embedding, frames) replaces path, label and vector of the row of that name; of several
    rows of one name the greatest path counts. Frames stay when the new ones are missing. Faces of an updated video are
    cleared. New rows get ids after the largest one, in path order, and after the one that ``meta`` remembers, so ids of
    deleted rows are never used again; put ``with_last_id(meta, videos)`` by with the result.
    """
    incoming = last_per_key(incoming.withColumn("_file", basename(F.col("path"))), "_file", "path").drop("_file")
    named = videos.withColumn("_name", basename(F.col("path")))
    fresh = incoming.select(
        basename(F.col("path")).alias("_name"), F.col("path").alias("_path"), F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"), F.col("frames").alias("_frames"), F.lit(True).alias("_new"),
    )
    both = named.join(fresh, "_name", "full_outer")
    old = both.filter("id is not null")
    hit = F.col("_new").isNotNull()
    others = [c for c in videos.columns if c not in ("id", "path", "label", "embedding", "frames")]
    updated = old.select(
        "id",
        F.when(hit, F.col("_path")).otherwise(F.col("path")).alias("path"),
        F.when(hit, F.col("_label")).otherwise(F.col("label")).alias("label"),
        F.when(hit, F.col("_embedding")).otherwise(F.col("embedding")).alias("embedding"),
        F.coalesce("_frames", "frames").alias("frames"),
        *others,
    )
    last = videos.select(F.col("id").cast("long").alias("id"))
    if meta is not None:
        last = last.unionByName(meta.filter(F.col("key") == LAST_ID).select(F.col("value").cast("long").alias("id")))
    last = last.agg(F.coalesce(F.max("id"), F.lit(0)))
    new = both.filter("id is null").select("_path", "_label", "_embedding", "_frames")
    added = new.join(with_row_number(new.select("_path"), "_path", name="_n"), "_path")
    inserted = added.select(
        (last.scalar() + F.col("_n")).alias("id"), F.col("_path").alias("path"), F.col("_label").alias("label"),
        F.col("_embedding").alias("embedding"), F.col("_frames").alias("frames"),
    )
    cleared = old.filter(hit).select(F.col("id").alias("video_id"))
    new_faces = faces.join(cleared, "video_id", "left_anti").select(*faces.columns)
    new_videos = updated.unionByName(inserted, allowMissingColumns=True)
    return new_videos, new_faces, without_orphans(persons, new_faces)


def with_last_id(meta: DataFrame, videos: DataFrame) -> DataFrame:
    """``meta`` with the largest video id so far; ``emptied`` tables start again without it."""
    ids = videos.select(F.col("id").cast("long").alias("id")).unionByName(
        meta.filter(F.col("key") == LAST_ID).select(F.col("value").cast("long").alias("id"))
    )
    entry = ids.agg(F.max("id").cast("string").alias("value")).filter("value is not null")
    return set_meta(meta, entry.select(F.lit(LAST_ID).alias("key"), "value"))


def update_vectors(videos: DataFrame, results: DataFrame) -> DataFrame:
    """Finished analyses (id, label, embedding, frames) written into existing rows; faces are not involved.

    Of several analyses of one id the greatest by all columns counts.
    """
    new = last_per_key(results, "id").select(
        "id", F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), F.col("frames").alias("_frames"),
        F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull()
    return videos.join(new, "id", "left").withColumns(
        {
            "label": F.when(hit, F.col("_label")).otherwise(F.col("label")),
            "embedding": F.when(hit, F.col("_embedding")).otherwise(F.col("embedding")),
            "frames": F.coalesce("_frames", "frames"),
        }
    ).select(*videos.columns)


def correct_labels(videos: DataFrame, feedback: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos, feedback) after corrections (video_id, corrected_label, created_at): the last counts, all are learned."""
    rows = corrections.join(videos.select(F.col("id").alias("video_id"), "embedding"), "video_id")
    learned = rows.filter(F.col("embedding").isNotNull()).select(
        "video_id", "corrected_label", "embedding", "created_at"
    )
    final = last_per_key(corrections.select("video_id", "corrected_label", "created_at"), "video_id", "created_at")
    changed = final.select(F.col("video_id").alias("id"), F.col("corrected_label").alias("_label"))
    relabelled = videos.join(changed, "id", "left").withColumn("label", F.coalesce("_label", "label"))
    return relabelled.select(*videos.columns), feedback.unionByName(learned, allowMissingColumns=True)


def usable_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("embedding").isNotNull()).select("corrected_label", "embedding")


def delete_videos(
    videos: DataFrame, faces: DataFrame, persons: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, faces, persons) without the videos in ``gone`` (id), their faces and persons left without one."""
    new_faces = faces.join(gone.select(F.col("id").alias("video_id")), "video_id", "left_anti").select(*faces.columns)
    return without_ids(videos, gone), new_faces, without_orphans(persons, new_faces)


def created_within(videos: DataFrame, hours: float, now: Column) -> DataFrame:
    """Videos created in the last ``hours`` before ``now``, to the second; these are the ones to delete."""
    since = F.date_trunc("second", now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    return videos.filter(F.date_trunc("second", "created_at") >= F.date_trunc("second", since))


def emptied(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Empty tables of the same schemas; ids start again because they follow the largest id in a table."""
    return tuple(t.sparkSession.createDataFrame([], t.schema) for t in tables)


def repoint(videos: DataFrame, conversions: DataFrame) -> DataFrame:
    """New paths after conversion: rows whose file name is that of ``old_path`` move to ``new_path``."""
    moves = last_per_key(conversions.select(basename(F.col("old_path")).alias("_name"), F.col("new_path").alias("_to")), "_name")
    return videos.withColumn("_name", basename(F.col("path"))).join(moves, "_name", "left").withColumn(
        "path", F.coalesce("_to", "path")
    ).select(*videos.columns)


def video_vectors(videos: DataFrame) -> DataFrame:
    """(id, embedding) of the rows that have a vector, by id."""
    return videos.filter(F.col("embedding").isNotNull()).select("id", "embedding").orderBy("id")


# ---------------------------------------------------------------- people


def rename_people(people: DataFrame, renames: DataFrame, key: str = "person_id") -> DataFrame:
    """Names from ``renames`` (key, new_name); unknown keys change nothing, of several names the greatest counts."""
    final = last_per_key(renames.select(key, "new_name"), key)
    return people.join(final, key, "left").withColumn(
        "name", F.coalesce("new_name", "name")
    ).select(*people.columns)


def remove_photos(people: DataFrame, person_photos: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, person_photos) without the removed paths; people emptied by it go, others stay."""
    left = person_photos.join(removed.select("path"), "path", "left_anti").select(*person_photos.columns)
    touched = person_photos.join(removed.select("path"), "path", "left_semi").select("person_id")
    emptied_ids = touched.join(left.select("person_id"), "person_id", "left_anti")
    return people.join(emptied_ids, "person_id", "left_anti"), left


def remove_stale_people(people: DataFrame, person_photos: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people with a live photo, one row of removed and remaining counts)."""
    alive = person_photos.join(live.select("path"), "path", "left_semi").select("person_id")
    kept = people.join(alive, "person_id", "left_semi")
    flags = people.join(alive.distinct().withColumn("_alive", F.lit(True)), "person_id", "left")
    counts = flags.agg(
        F.count_if(F.col("_alive").isNull()).alias("removed"), F.count_if(F.col("_alive").isNotNull()).alias("remaining")
    )
    return kept, counts


def delete_photos(
    manifest: DataFrame, vectors: DataFrame, people: DataFrame, person_photos: DataFrame, removed: DataFrame
) -> dict[str, DataFrame]:
    """Manifest, vectors, people and person photos without the removed paths."""
    new_people, new_photos = remove_photos(people, person_photos, removed)
    gone = removed.select("path")
    return {
        "manifest": manifest.join(gone, "path", "left_anti"),
        "vectors": vectors.join(gone, "path", "left_anti"),
        "people": new_people,
        "person_photos": new_photos,
    }


def add_face(faces: DataFrame, new_faces: DataFrame) -> DataFrame:
    return faces.unionByName(new_faces, allowMissingColumns=True)


def faces_to_clean(faces: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """``faces`` (id, thumbnail_path) that should be removed, with the reason. ``thumbnails`` lists readable files."""
    present = thumbnails.select(basename(F.col("path")).alias("thumbnail_path"), F.lit(True).alias("_present")).distinct()
    checked = faces.join(present, "thumbnail_path", "left")
    reason = cleanup_reason(F.col("confidence"), F.col("pose_yaw"), F.col("_present"))
    return checked.select("id", "thumbnail_path", reason.alias("reason")).filter(F.col("reason").isNotNull())


# ---------------------------------------------------------------- settings and model versions


def get_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    row = meta.filter(F.col("key") == key).select("value").first()
    return default if row is None else row["value"]


def set_meta(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Upsert (key, value) rows; of several values of a key the greatest counts."""
    entries = last_per_key(entries.select("key", "value"), "key")
    return meta.join(entries.select("key"), "key", "left_anti").unionByName(entries)


def stored_model(meta: DataFrame, vectors: DataFrame, current: str, key: str = "clip_model") -> str:
    """Model the stored vectors come from: the record, else the legacy model, else (no vectors) the current one."""
    recorded = get_meta(meta, key)
    return recorded or (current if vectors.isEmpty() else LEGACY_MODEL_ID)


def split_by_model(vectors: DataFrame, model_id: str) -> tuple[DataFrame, DataFrame]:
    """(usable, to re-embed): vectors of the current model and the paths of all others."""
    current = F.coalesce(F.col("model_id"), F.lit(LEGACY_MODEL_ID)) == model_id
    return vectors.filter(current), vectors.filter(~current).select("path").distinct()
