"""The vector table: parquet partitioned by kind and model, so a search reads the files of one index only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.functions.vectors import l2_normalize
from reelgraph.schemas import VECTORS


def as_stored(vectors: DataFrame, kind: str, model_id: str) -> DataFrame:
    """(path, seq, embedding, kind, model_id) with unit vectors; rows without a vector are left out."""
    usable = vectors.filter(F.size("embedding") > 0)
    return usable.select(
        "path", F.col("seq").cast("long").alias("seq"), l2_normalize("embedding").cast("array<float>").alias("embedding"),
        F.lit(kind).alias("kind"), F.lit(model_id).alias("model_id"),
    )


def write_vectors(vectors: DataFrame, table: str, kind: str, model_id: str, mode: str = "append") -> None:
    """Normalise and store. Overwriting replaces the one (kind, model) partition."""
    writer = as_stored(vectors, kind, model_id).write.mode(mode).partitionBy("kind", "model_id")
    writer.option("partitionOverwriteMode", "dynamic").parquet(table)


def read_vectors(spark: SparkSession, table: str, kind: str | None = None, model_id: str | None = None) -> DataFrame:
    vectors = spark.read.schema(VECTORS).parquet(table)
    if kind is not None:
        vectors = vectors.filter(F.col("kind") == kind)
    return vectors if model_id is None else vectors.filter(F.col("model_id") == model_id)


def write_manifest(vectors: DataFrame, folder: str) -> None:
    """Tracked paths as JSON rows."""
    vectors.select("path", "seq").write.mode("overwrite").json(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, seq long").json(folder)


def next_seq(vectors: DataFrame) -> int:
    """First free sequence number."""
    last = vectors.agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1
