"""Media files as tables. The file source lists in parallel, and unread content columns cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.functions.media import IMAGE_EXTENSIONS, IMPORT_VIDEO_EXTENSIONS, has_extension
from reelgraph.functions.text import basename


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...], *, recursive: bool = False) -> DataFrame:
    """(path, modification_time, length) of the files with one of the extensions, by any case; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(has_extension(F.col("path"), extensions)).select(
        "path", F.col("modificationTime").alias("modification_time"), "length"
    )


def photo_files(spark: SparkSession, folder: str, library: str = "test_images") -> DataFrame:
    """The photo library: ``<library>/<name>`` paths in order."""
    names = scan_files(spark, folder, IMAGE_EXTENSIONS).withColumn(
        "path", F.concat(F.lit(library + "/"), basename(F.col("path")))
    )
    return names.orderBy("path")


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """Videos below a folder, or one video file."""
    return scan_files(spark, path, IMPORT_VIDEO_EXTENSIONS, recursive=True)


def file_signatures(files: DataFrame) -> DataFrame:
    """(path, mtime_ns, size)."""
    return files.select(
        "path", (F.unix_micros("modification_time") * 1000).alias("mtime_ns"), F.col("length").alias("size")
    )


def accepted_uploads(uploads: DataFrame, library: str = "test_images") -> DataFrame:
    """Uploads (file_name) with an image extension, stored under their bare name."""
    name = basename(F.replace(F.col("file_name"), F.lit("\\"), F.lit("/")))
    return uploads.filter(has_extension(F.col("file_name"), IMAGE_EXTENSIONS)).withColumn(
        "path", F.concat(F.lit(library + "/"), name)
    )


def largest_faces(detections: DataFrame, key: str = "path", order: str = "det_ord") -> DataFrame:
    """(key, embedding) of the detection with the largest box per item, the first on ties."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return detections.groupBy(key).agg(F.max_by("embedding", F.struct(area, -F.col(order))).alias("embedding"))


def most_confident_faces(detections: DataFrame, key: str = "path", order: str = "det_ord") -> DataFrame:
    """(key, embedding) of the detection with the highest score per item, the first on ties."""
    return detections.groupBy(key).agg(
        F.max_by("embedding", F.struct(F.col("det_score"), -F.col(order))).alias("embedding")
    )
