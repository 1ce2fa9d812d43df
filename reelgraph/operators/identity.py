"""Faces and persons: exemplars, best match, incremental linking, rebuilds, near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.media import face_gate, thumbnail_score
from reelgraph.functions.vectors import l2_normalize, squared_norm
from reelgraph.operators.clustering import (
    COMPONENT_THRESHOLD,
    greedy_leader_clusters,
    grouped_leaders,
    nearest_partner,
    similarity_components,
    two_stage_clusters,
)
from reelgraph.operators.ranking import dense_ids
from reelgraph.session import cut

LINK_THRESHOLD = 0.32
DUPLICATE_THRESHOLD = 0.90


def known_people(faces: DataFrame) -> DataFrame:
    """(person_id, embedding): unit vectors of linked faces; missing, empty and zero vectors are left out."""
    linked = faces.filter(F.col("person_id").isNotNull() & (F.size("embedding") > 0))
    return linked.filter(squared_norm("embedding") > 0).select("person_id", l2_normalize("embedding").alias("embedding"))


def best_person(
    faces: DataFrame, exemplars: DataFrame, threshold: float = LINK_THRESHOLD, *, id_col: str = "id",
    vec: str = "embedding", broadcast_bytes: int | None = None,
) -> DataFrame:
    """``faces`` with person_id and sim of the closest exemplar's person, both null below the threshold."""
    best = nearest_partner(
        exemplars.select(F.col("person_id").cast("long").alias("_p"), F.col(vec)),
        faces.select(F.col(id_col).cast("long").alias("_id"), F.col(vec)), vec=vec, broadcast_bytes=broadcast_bytes,
    )
    hits = best.filter(F.col("sim") >= threshold).select(
        F.col("id").alias(id_col), F.col("partner").alias("person_id"), "sim"
    )
    return faces.drop("person_id", "sim").join(hits, id_col, "left")


def majority_names(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, name): the most frequent non-null name, ties to the smallest; clusters without one are absent."""
    votes = members.filter(F.col("name").isNotNull()).groupBy(cluster, "name").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(cluster).agg(F.min_by("name", F.struct(-F.col("_n"), F.col("name"))).alias("name"))


def best_thumbnails(members: DataFrame, cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """(cluster, thumbnail) of the face with the highest score, the earliest on ties."""
    score = thumbnail_score(F.col("confidence"), F.col("pose_yaw"))
    return members.groupBy(cluster).agg(
        F.max_by("thumbnail_path", F.struct(score, -F.col(id_col))).alias("thumbnail")
    )


def rebuild_video_people(
    faces: DataFrame, persons: DataFrame, threshold: float = COMPONENT_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """New (persons, faces): components of the similarity graph, ids from 1 in the order of their first face."""
    components = cut(similarity_components(faces, threshold, id_col="id"))
    ids = cut(dense_ids(components, "component", "_rank").select("component", (F.col("_rank") + 1).alias("cluster")))
    placed = components.join(ids, "component").select("id", "cluster")
    names = persons.select(F.col("id").alias("person_id"), "name")
    members = cut(
        faces.select("id", "person_id", "thumbnail_path", "confidence", "pose_yaw")
        .join(names, "person_id", "left")
        .join(placed, "id")
    )
    new_persons = (
        best_thumbnails(members)
        .join(majority_names(members), "cluster", "left")
        .select(F.col("cluster").alias("id"), "name", "thumbnail")
    )
    new_faces = faces.drop("person_id").join(placed.select("id", F.col("cluster").alias("person_id")), "id")
    return new_persons, new_faces.select(*faces.columns)


def photos_per_person(labelled: DataFrame, id_col: str = "seq") -> DataFrame:
    """(person_id, path, seq): each photo once per person at its first place; noise is skipped."""
    real = labelled.filter(F.col("label") != -1)
    person = F.concat(F.lit("Person_"), F.col("label").cast("string"))
    return real.groupBy(person.alias("person_id"), "path").agg(F.min(id_col).alias("seq"))


def save_people(
    people: DataFrame, person_photos: DataFrame, labelled: DataFrame, *, overwrite: bool = False, id_col: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """New (people, person_photos) after a clustering. Without ``overwrite`` names are kept and photos are added."""
    found = photos_per_person(labelled, id_col)
    number = F.regexp_extract("person_id", r"_(\d+)$", 1).cast("long")
    default = F.concat(F.lit("Person "), (number + 1).cast("string"))
    fresh = found.select("person_id").distinct().withColumn("_default", default)
    if overwrite:
        return fresh.select("person_id", F.col("_default").alias("name")), found
    unnamed = F.col("name").isNull() | F.col("name").isin("", "Unknown")
    merged = people.join(fresh, "person_id", "full_outer").select(
        "person_id", F.when(unnamed & F.col("_default").isNotNull(), F.col("_default")).otherwise(F.col("name")).alias("name")
    )
    # Photos a person already has keep their place; new ones come after them.
    last = person_photos.groupBy("person_id").agg(F.max("seq").alias("_last"))
    added = found.join(person_photos.select("person_id", "path"), ["person_id", "path"], "left_anti").join(
        last, "person_id", "left"
    )
    added = added.select("person_id", "path", (F.col("seq") + F.coalesce(F.col("_last") + 1, F.lit(0))).alias("seq"))
    kept = person_photos.groupBy("person_id", "path").agg(F.min("seq").alias("seq"))
    return merged, kept.unionByName(added)


def rebuild_photo_people(
    vectors: DataFrame, *, old_people: DataFrame | None = None, old_photos: DataFrame | None = None, **clustering
) -> tuple[DataFrame, DataFrame]:
    """(people, person_photos) from scratch with two-stage clustering.

    Custom names are lost, as the overwrite means; give ``old_people`` and ``old_photos`` to carry the most frequent
    old name of the photos of each new person.
    """
    labels = two_stage_clusters(vectors, **{"min_cluster_size": 1, **clustering})
    people, photos = save_people(None, None, labels.join(vectors.select("seq", "path"), "seq"), overwrite=True)
    if old_people is not None and old_photos is not None:
        photos = cut(photos)
        named = old_photos.join(old_people, "person_id").select("path", "name")
        votes = majority_names(photos.join(named, "path"), "person_id").withColumnRenamed("name", "_old")
        people = people.join(votes, "person_id", "left").select("person_id", F.coalesce("_old", "name").alias("name"))
    return people, photos


def duplicate_faces(
    faces: DataFrame, threshold: float = DUPLICATE_THRESHOLD, *, video_id: int | None = None, chunk_rows: int = 1000,
    large_rows: int = 1 << 20,
) -> DataFrame:
    """Ids of faces more similar than the threshold to an earlier kept face of the same person."""
    if video_id is not None:
        faces = faces.filter(F.col("video_id") == video_id)
    kept = grouped_leaders(faces, "person_id", threshold, strict=True, chunk_rows=chunk_rows, large_rows=large_rows)
    return faces.select("id").join(kept, F.col("id") == F.col("leader"), "left_anti")


def remove_duplicate_faces(faces: DataFrame, threshold: float = DUPLICATE_THRESHOLD, **options) -> DataFrame:
    return faces.join(duplicate_faces(faces, threshold, **options), "id", "left_anti")


def gated_detections(detections: DataFrame) -> DataFrame:
    """Detections good enough to become faces."""
    return detections.filter(
        face_gate(*[F.col(c) for c in ("det_score", "yaw", "x1", "y1", "x2", "y2", "blur_var")])
    )


def link_faces(
    detections: DataFrame, faces: DataFrame, next_person_id: int, threshold: float = LINK_THRESHOLD, *,
    id_col: str = "det_id",
) -> tuple[DataFrame, DataFrame]:
    """Link a batch of detections to the people in ``faces``: (linked, new_persons).

    Detections pass the quality gate and take the person of their closest exemplar in the registry as it was before
    the batch. The rest are grouped by greedy leaders at the same threshold and each group becomes a person,
    numbered from ``next_person_id``. A person is linked once per video, by its first detection. One detection at
    a time, an exemplar added by the batch itself could already match later ones; link smaller batches where that
    matters.
    """
    good = cut(gated_detections(detections))
    matched = cut(best_person(good, known_people(faces), threshold, id_col=id_col))
    open_faces = matched.filter(F.col("person_id").isNull())
    groups = cut(greedy_leader_clusters(open_faces.select(id_col, "embedding"), threshold, id_col=id_col))
    ids = cut(dense_ids(groups, "leader", "_rank").withColumn("_new", F.col("_rank") + next_person_id))
    fresh = groups.join(ids, "leader").select(id_col, "_new")
    assigned = matched.join(fresh, id_col, "left").withColumn("person_id", F.coalesce("person_id", "_new")).drop("_new")
    first = Window.partitionBy("video_id", "person_id").orderBy(id_col)
    linked = assigned.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    new_persons = ids.select(F.col("_new").alias("id"), F.lit(None).cast("string").alias("name"))
    return linked, new_persons
