"""Logical media-library tables derived from the sample tables, as DataFrames and as SQL with the same content.

Two registries: orders, lineitem and supplier stand for videos, faces and persons; events and customer stand for
photos of people. Embeddings are the vectors, in order of their id; 14 in a row are the frames of a video.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.functions.vectors import l2_normalize
from reelgraph.operators.pooling import pool_vectors
from reelgraph.session import checkpoint_dir

SQL = {
    # vectors with unit length, and the ten label centroids that serve as text queries
    "vectors": """
        SELECT seq, path, label, list_transform(v, lambda x: x / n) AS u FROM (
            SELECT vec_id AS seq, 'item_' || vec_id || '.jpg' AS path, label, embedding::DOUBLE[] AS v,
                   sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "elements": "SELECT seq, label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM vectors",
    "centroids": """
        SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM (
            SELECT label, list(x ORDER BY pos) AS m FROM (
                SELECT label, pos, avg(x) AS x FROM elements GROUP BY label, pos) GROUP BY label)""",
    "frames": "SELECT seq // 14 AS video_id, seq % 14 AS frame_idx, u FROM vectors",
    # longer videos of 40 frames, one in thirty of what was filmed
    "long_frames": "SELECT seq // 40 AS video_id, seq % 40 * 30 AS frame_idx, u FROM vectors",
    # registry of videos, faces and persons
    "videos": """
        SELECT o_orderkey AS id, 'uploaded_videos/clip_' || o_custkey || '.mp4' AS path,
               CASE o_orderstatus WHEN 'P' THEN 'Processing AI tags...' WHEN 'O' THEN 'unknown'
                    ELSE o_orderpriority || ', Clip' END AS label,
               o_totalprice >= 50000 AS has_vector, o_totalprice, o_orderdate AS created_at, o_custkey FROM orders""",
    "faces": """
        SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id,
               l_orderkey AS video_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS person_id,
               'face_' || l_partkey || '_' || l_suppkey || '.jpg' AS thumbnail_path, l_discount * 10 AS confidence,
               CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE (l_quantity - 25) * 3.5 END AS pose_yaw,
               l_tax FROM lineitem""",
    "persons": """
        SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS name,
               'person_' || s_suppkey || '.jpg' AS thumbnail FROM supplier""",
    "files": """
        SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'moved/clip_' ELSE 'uploaded_videos/clip_' END
               || c_custkey || '.mp4' AS path FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT 'uploaded_videos/new_' || c_custkey || '.mp4' FROM customer WHERE c_nationkey = 3""",
    "video_thumbs": "SELECT 'clip_' || c_custkey AS stem FROM customer WHERE c_acctbal < 9000",
    # photos of people
    "people": """
        SELECT 'Person_' || c_custkey AS person_id, CASE WHEN c_acctbal < 0 THEN NULL
               WHEN c_mktsegment = 'BUILDING' THEN 'Unknown' ELSE c_name END AS name FROM customer""",
    "person_photos": """
        SELECT 'Person_' || user_id AS person_id, 'photo_' || regexp_extract(props, '(\\d+)', 1) || '.jpg' AS path,
               event_id AS seq FROM events""",
    "live": "SELECT 'photo_' || page_id || '.jpg' AS path FROM pages WHERE url LIKE 'https%'",
    "event_faces": """
        SELECT event_id AS id, user_id AS person_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS video_id,
               value FROM events""",
    "customers": "SELECT c_custkey AS id, c_name AS name, 'person_' || c_custkey || '.jpg' AS thumbnail FROM customer",
}


def scratch(t: Tables) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(t.spark)}/plan-{uuid.uuid4()}"


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("seq"), F.concat(F.lit("item_"), F.col("vec_id"), F.lit(".jpg")).alias("path"),
            "embedding", "label",
        )

    @cached_property
    def unit_vectors(self) -> DataFrame:
        return self.vectors.withColumn("embedding", l2_normalize("embedding"))

    @cached_property
    def centroids(self) -> DataFrame:
        return pool_vectors(self.unit_vectors, ["label"])

    @property
    def label_queries(self) -> DataFrame:
        return self.centroids.select(F.col("label").cast("long").alias("query_id"), "embedding")

    @property
    def label_vectors(self) -> DataFrame:
        return self.centroids.select(
            F.concat(F.lit("label "), F.col("label")).alias("label"), F.col("label").alias("label_ord"), "embedding"
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.unit_vectors.select(
            F.expr("seq div 14").alias("video_id"), (F.col("seq") % 14).cast("int").alias("frame_idx"), "embedding"
        )

    @cached_property
    def long_frames(self) -> DataFrame:
        return self.unit_vectors.select(
            F.expr("seq div 40").alias("video_id"), (F.col("seq") % 40 * 30).cast("int").alias("frame_idx"), "embedding"
        )

    @cached_property
    def videos(self) -> DataFrame:
        label = (
            F.when(F.col("o_orderstatus") == "P", F.lit("Processing AI tags..."))
            .when(F.col("o_orderstatus") == "O", F.lit("unknown"))
            .otherwise(F.concat("o_orderpriority", F.lit(", Clip")))
        )
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("uploaded_videos/clip_"), F.col("o_custkey"), F.lit(".mp4")).alias("path"),
            label.alias("label"),
            F.when(F.col("o_totalprice") >= 50000, F.array("o_totalprice")).alias("embedding"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def faces(self) -> DataFrame:
        number = (
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
        ) * 10000 + F.col("l_suppkey")
        no_yaw = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
        return self.read("lineitem").select(
            number.alias("id"),
            F.col("l_orderkey").alias("video_id"),
            F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("person_id"),
            F.concat(F.lit("face_"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey"), F.lit(".jpg")).alias(
                "thumbnail_path"
            ),
            (F.col("l_discount") * 10).alias("confidence"),
            F.when(~no_yaw, (F.col("l_quantity") - 25) * 3.5).alias("pose_yaw"),
            "l_tax",
        )

    @cached_property
    def persons(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name"),
            F.concat(F.lit("person_"), F.col("s_suppkey"), F.lit(".jpg")).alias("thumbnail"),
        )

    @cached_property
    def files(self) -> DataFrame:
        c = self.read("customer")
        folder = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("moved/clip_")).otherwise(
            F.lit("uploaded_videos/clip_")
        )
        there = c.filter("c_acctbal >= 0").select(F.concat(folder, F.col("c_custkey"), F.lit(".mp4")).alias("path"))
        new = c.filter("c_nationkey = 3").select(
            F.concat(F.lit("uploaded_videos/new_"), F.col("c_custkey"), F.lit(".mp4")).alias("path")
        )
        return there.unionByName(new)

    @cached_property
    def video_thumbs(self) -> DataFrame:
        return self.read("customer").filter("c_acctbal < 9000").select(
            F.concat(F.lit("thumbs/clip_"), F.col("c_custkey"), F.lit(".jpg")).alias("path")
        )

    @cached_property
    def people(self) -> DataFrame:
        name = (
            F.when(F.col("c_acctbal") < 0, F.lit(None))
            .when(F.col("c_mktsegment") == "BUILDING", F.lit("Unknown"))
            .otherwise(F.col("c_name"))
        )
        return self.read("customer").select(
            F.concat(F.lit("Person_"), F.col("c_custkey")).alias("person_id"), name.alias("name")
        )

    @cached_property
    def person_photos(self) -> DataFrame:
        number = F.regexp_extract("props", r"(\d+)", 1)
        return self.read("events").select(
            F.concat(F.lit("Person_"), F.col("user_id")).alias("person_id"),
            F.concat(F.lit("photo_"), number, F.lit(".jpg")).alias("path"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.read("pages").filter(F.col("url").startswith("https")).select(
            F.concat(F.lit("photo_"), F.col("page_id"), F.lit(".jpg")).alias("path")
        )

    @cached_property
    def event_faces(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("person_id"),
            F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("video_id"), "value",
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("person_"), F.col("c_custkey"), F.lit(".jpg")).alias("thumbnail"),
        )
