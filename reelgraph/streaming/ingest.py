"""Continuous ingest: watched folders, drained queues, remembered negatives, running averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reelgraph.functions.media import WATCHED_IMAGE_EXTENSIONS, has_extension
from reelgraph.operators.identity import LINK_THRESHOLD
from reelgraph.operators.library import cached_live_unindexed
from reelgraph.operators.linking import SEEN, link_faces_in_order
from reelgraph.operators.progress import fold_averages
from reelgraph.schemas import FILES
from reelgraph.session import cut
from reelgraph.sources.encoders import Encoder, embed_photos, valid_vectors
from reelgraph.sources.table_store import TableStore

LINKED = "det_id long, video_id long, person_id long, sim double, embedding array<double>"


def watch_images(spark: SparkSession, folder: str, *, max_files: int | None = None) -> DataFrame:
    """Stream of new image files below ``folder``."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).filter(has_extension(F.col("path"), WATCHED_IMAGE_EXTENSIONS))


def append_vectors(vectors: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of vectors to a parquet table; one run takes what is there and stops."""
    return (
        vectors.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def index_new_images(images: DataFrame, factory: Callable[[], Encoder], table: str, checkpoint: str) -> StreamingQuery:
    """Embed each new image and append its vector."""
    return append_vectors(valid_vectors(embed_photos(images, factory)), table, checkpoint)


def index_until_quiet(start: Callable[[], StreamingQuery], rows: Callable[[], int]) -> int:
    """Repeat passes until one adds nothing; ``rows`` counts what is stored. Returns how many passes added something."""
    passes, stored = 0, rows()
    while True:
        start().awaitTermination()
        before, stored = stored, rows()
        if stored == before:
            return passes
        passes += 1


def stored_rows(spark: SparkSession, table: str, schema) -> Callable[[], int]:
    """A counter of the rows in a parquet table that may not be there yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(table)
    return lambda: spark.read.schema(schema).parquet(table).count()


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drain_query(
    source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Hand all waiting batches to ``each`` and wait for the end.

    A batch may be repeated after a failure: ``each`` should write by batch id (overwrite a folder, or merge).
    """
    query = (
        source.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain(
    source: DataFrame, each: Callable[[DataFrame, int], int], finish: Callable[[], None], checkpoint: str
) -> int:
    """Handle all waiting batches, then call ``finish`` once. Returns the number of rows handled.

    ``each`` returns how many rows it handled; a batch that is repeated counts once.
    """
    handled: dict[int, int] = {}

    def count(batch: DataFrame, batch_id: int) -> None:
        handled[batch_id] = each(batch, batch_id) or 0

    drain_query(source, count, checkpoint)
    finish()
    return sum(handled.values())


# ---------------------------------------------------------------- keyed state


def folded_average(stream: DataFrame, table: str, checkpoint: str, key: str = "job") -> DataFrame:
    """Run the waiting batches of ``stream`` into a state table with one partition per batch; returns the last state.

    A batch reads the state of the batch before it and overwrites its own, so a repeated batch gives the same state.
    States older than the one before are removed.
    """
    spark = stream.sparkSession
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, rate double, n long"
    if not folder_exists(spark, table):
        spark.createDataFrame([], schema).write.parquet(f"{table}/batch=-1")

    def states() -> DataFrame:
        return spark.read.schema(schema + ", batch long").parquet(table)

    def each(batch: DataFrame, batch_id: int) -> None:
        before = states().filter(F.col("batch") == batch_id - 1).drop("batch")
        fold_averages(before, batch, key).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        remove_folder(spark, f"{table}/batch={batch_id - 2}")

    drain_query(stream, each, checkpoint)
    last = states().agg(F.max("batch")).scalar()
    return states().filter(F.col("batch") == F.coalesce(last, F.lit(-1))).drop("batch")


# ---------------------------------------------------------------- tables kept across passes


def remember_empty(cache: DataFrame, live: DataFrame, indexed: DataFrame, found_empty: DataFrame) -> DataFrame:
    """New negative cache: old entries that are live and not indexed, overridden by what this pass found empty."""
    kept = cached_live_unindexed(cache, live, indexed)
    fresh = found_empty.select("path", "mtime_ns", "size")
    return kept.join(fresh.select("path"), "path", "left_anti").select("path", "mtime_ns", "size").unionByName(fresh)


def seed_empty(semantic: DataFrame, face: DataFrame, signatures: DataFrame) -> DataFrame:
    """First negative cache of an older library: photos with a semantic vector but no face were scanned before."""
    scanned = semantic.select("path").join(face.select("path"), "path", "left_anti").distinct()
    return scanned.join(signatures, "path").select("path", "mtime_ns", "size")


# ---------------------------------------------------------------- linking against a stored registry


def start_registry(store: TableStore, faces: DataFrame, next_person_id: int) -> None:
    """The first version of a registry that ``link_batch`` goes on with: faces, no new people, nothing seen yet."""
    spark = faces.sparkSession
    known = faces.select(F.col("person_id").cast("long"), F.col("embedding").cast("array<double>"))
    empty = {"linked": LINKED, "persons": "id long, name string", "seen": SEEN}
    tables = {"faces": known} | {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    store.write(tables, facts={"next_person": next_person_id, "batch": -1})


def link_batch(store: TableStore, threshold: float = LINK_THRESHOLD, **options) -> Callable[[DataFrame, int], int]:
    """``foreachBatch`` body: link detections to the people in ``store`` and commit what it found with the batch's number.

    Faces, people, the next id and what open videos have seen are read from the version that counts and written as the
    next one, all at once. A batch that is repeated, after a failure before or after the commit, changes nothing that is
    committed already. Returns how many detections the batch linked.
    """

    def each(detections: DataFrame, batch_id: int) -> int:
        version = store.version()
        facts = store.facts()
        if facts["batch"] >= batch_id:
            return 0
        linked, people, seen = link_faces_in_order(
            detections, store.read("faces"), facts["next_person"], threshold, seen=store.read("seen"), **options
        )
        new = cut(linked.select(*(F.col(name).cast(kind) for name, kind in (c.split() for c in LINKED.split(", ")))))
        people, count = cut(people), new.count()
        added = {"linked": new, "persons": people, "faces": new.select("person_id", "embedding"), "seen": seen}
        store.write({}, append=added, base=version, facts={"next_person": facts["next_person"] + people.count(), "batch": batch_id})
        return count

    return each
