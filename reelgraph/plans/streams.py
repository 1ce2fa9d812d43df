"""Streams over the sample tables and encoders run on their texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.text import expand_queries
from reelgraph.operators.progress import fold_averages
from reelgraph.plans import people
from reelgraph.plans.catalog import query
from reelgraph.plans.columns import _PROMPT_SQL, part_queries
from reelgraph.plans.libraries import _RATES
from reelgraph.plans.people import ORDER_SQL
from reelgraph.plans.tables import scratch
from reelgraph.sources import encoders as EN
from reelgraph.sources import vector_table as VT
from reelgraph.sources.table_store import TableStore
from reelgraph.streaming import ingest as N

LETTERS = "aeinrst"


def letter_counts():
    """Stand-in encoder: how often each of a few letters occurs."""

    def encode(inputs: list) -> list:
        return [[float(text.count(c)) for c in LETTERS] for text in inputs]

    return encode


def stream(t, name: str, batches: int = 3) -> DataFrame:
    """One sample table as a file stream of several batches: a copy in files of equal size, as many a batch as it has splits."""
    copy = f"{scratch(t)}/{name}"
    rows = t.read(name)
    files = max(1, math.ceil(rows.rdd.getNumPartitions() / batches))
    rows.repartition(batches * files).write.parquet(copy)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(copy)


def _letters(column: str) -> str:
    counts = ", ".join(f"len({column}) - len(replace({column}, '{c}', ''))" for c in LETTERS)
    return f"[{counts}]::DOUBLE[]"


def _elements(vectors: DataFrame, key: str, digits: int) -> DataFrame:
    """(key, pos, x): a rounded row for each element."""
    rows = vectors.select(key, F.posexplode("embedding").alias("p", "v"))
    return rows.select(key, (F.col("p") + 1).cast("long").alias("pos"), (F.round(F.col("v").cast("double"), digits) + 0.0).alias("x"))


@query("encoded_texts", "A11 J1", f"""
    WITH v AS (SELECT doc_id, {_letters('text')} AS v FROM documents)
    SELECT doc_id, unnest(list_transform(v, lambda x: round((x / (sqrt(list_dot_product(v, v)) + 1e-6))::FLOAT::DOUBLE, 6))) AS x,
           generate_subscripts(v, 1)::BIGINT AS pos FROM v""")
def _(t):
    vectors = EN.valid_vectors(EN.embed(t.read("documents"), "doc_id", "text", letter_counts, batch_size=16))
    rows = vectors.select("doc_id", F.posexplode("embedding").alias("p", "v"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.round(F.col("v").cast("double"), 6).alias("x"))


@query("encoded_prompts", "A12 B5 B4", f"""{_PROMPT_SQL},
    p AS (SELECT query_id, unnest(l) AS text FROM l),
    v AS (SELECT query_id, {_letters('text')} AS v FROM p),
    u AS (SELECT query_id, list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-6))::FLOAT::DOUBLE) AS u FROM v),
    e AS (SELECT query_id, unnest(u) AS x, generate_subscripts(u, 1)::BIGINT AS pos FROM u),
    m AS (SELECT query_id, pos, avg(x) AS x FROM e GROUP BY query_id, pos)
    SELECT query_id, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY query_id)) + 1e-6), 5) + 0.0 AS x FROM m""")
def _(t):
    encoded = EN.embed_prompts(expand_queries(part_queries(t)), letter_counts)
    return _elements(EN.query_vectors(encoded), "query_id", 5)


@query("caption_queries", "B6 A12", f"""
    WITH q AS (SELECT p_partkey AS query_id, p_name AS text FROM part),
    v AS (SELECT query_id, {_letters('text')} AS v FROM q UNION ALL
          SELECT query_id, {_letters("('a photo of ' || text)")} FROM q),
    u AS (SELECT query_id, list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-6))::FLOAT::DOUBLE) AS u FROM v),
    e AS (SELECT query_id, unnest(u) AS x, generate_subscripts(u, 1)::BIGINT AS pos FROM u),
    m AS (SELECT query_id, pos, sum(x) AS x FROM e GROUP BY query_id, pos)
    SELECT query_id, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY query_id)) + 1e-9), 5) + 0.0 AS x FROM m""")
def _(t):
    queries = t.read("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return _elements(EN.caption_query_vectors(queries, letter_counts), "query_id", 5)


def in_order(t, name: str, key: str, batches: int = 3) -> DataFrame:
    """A sample table as a file stream whose batches follow each other in the order of ``key``."""
    copy = f"{scratch(t)}/{name}"
    rows = t.read(name)
    edges = rows.approxQuantile(key, [(k + 1) / batches for k in range(batches - 1)], 0.0)
    for k in range(batches):
        low, high = ([None, *edges][k], [*edges, None][k])
        part = rows if low is None else rows.filter(F.col(key) > low)
        (part if high is None else part.filter(F.col(key) <= high)).coalesce(1).write.parquet(f"{copy}/{k}")
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return source.parquet(copy)


def _throughput(t) -> DataFrame:
    rows = in_order(t, "events", "event_id").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("items"), F.col("value").alias("seconds")
    )
    out = scratch(t)
    state = N.folded_average(rows, f"{out}/rates", f"{out}/state")
    return state.select("job", F.round("rate", 6).alias("rate"), "n")


@query("streamed_throughput", "I4 E12", _RATES + " SELECT job, round(rate, 6) AS rate, n FROM a")
def _(t):
    return _throughput(t)


@query("folded_throughput", "I4 E12", _RATES + " SELECT job, round(rate, 6) AS rate, n FROM a")
def _(t):
    # Without a stream: the state after the earlier half of the events, and the later half folded into it.
    rows = t.read("events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("items"), F.col("value").alias("seconds")
    )
    (edge,) = rows.approxQuantile("seq", [0.5], 0.0)
    state = t.spark.createDataFrame([], f"job {dict(rows.dtypes)['job']}, rate double, n long")
    for half in (F.col("seq") <= edge, F.col("seq") > edge):
        state = fold_averages(state, rows.filter(half), "job")
    return state.select("job", F.round("rate", 6).alias("rate"), "n")


@query("drained_queue", "I3", """
    SELECT doc_id, lang, (SELECT count(*) FROM documents) AS handled, (SELECT count(DISTINCT lang) FROM documents) AS langs FROM documents""")
def _(t):
    out = scratch(t)

    def each(batch: DataFrame, batch_id: int) -> int:
        batch.select("doc_id", "lang").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        return t.spark.read.parquet(f"{out}/rows/batch={batch_id}").count()

    def finish() -> None:  # once, over all that was handled
        rows = t.spark.read.parquet(f"{out}/rows")
        rows.agg(F.countDistinct("lang").alias("langs")).write.parquet(f"{out}/summary")

    handled = N.drain(stream(t, "documents"), each, finish, f"{out}/state")
    rows, summary = t.spark.read.parquet(f"{out}/rows"), t.spark.read.parquet(f"{out}/summary")
    return rows.select("doc_id", "lang", F.lit(handled).cast("long").alias("handled"), summary.scalar().alias("langs"))


def _streamed_links(t) -> TableStore:
    """A registry after detections have come in five batches, the second of which came twice."""
    out = scratch(t)
    store = TableStore(t.spark, f"{out}/registry")
    N.start_registry(store, people.faces(t).filter("person_id < 5"), 100)
    live = type(t)(t.spark, t.sf_dir)
    live.vectors = in_order(t, "embeddings", "vec_id", 5).select(F.col("vec_id").alias("seq"), "embedding", "label")
    link = N.link_batch(store)

    def each(batch: DataFrame, batch_id: int) -> int:
        found = link(batch, batch_id)
        return found + link(batch, batch_id) if batch_id == 1 else found

    N.drain(people.detections(live), each, lambda: None, f"{out}/state")
    return store


@query("streamed_links", "I5 F8", f"""
    WITH {ORDER_SQL} SELECT id, video_id, person_id FROM done JOIN good USING (i) WHERE stored""", "vectors")
def _(t):
    return _streamed_links(t).read("linked").select(F.col("det_id").alias("id"), "video_id", "person_id")


@query("streamed_vectors", "I1 I2 A11", f"""
    WITH v AS (SELECT page_id, {_letters('html')} AS v FROM pages),
    u AS (SELECT page_id, list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-6))::FLOAT::DOUBLE) AS u FROM v)
    SELECT page_id, generate_subscripts(u, 1)::BIGINT AS pos, round(unnest(u), 6) + 0.0 AS x FROM u""")
def _(t):
    out = scratch(t)
    vectors = EN.valid_vectors(EN.embed(stream(t, "pages"), "page_id", "html", letter_counts))
    stored = N.stored_rows(t.spark, f"{out}/vectors", vectors.schema)
    N.index_until_quiet(lambda: N.append_vectors(vectors, f"{out}/vectors", f"{out}/state"), stored)
    return _elements(t.spark.read.schema(vectors.schema).parquet(f"{out}/vectors"), "page_id", 6)


@query("remembered_empty", "I6", """
    SELECT o_orderkey AS path, o_custkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS size FROM orders
    WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def _(t):
    orders = t.read("orders").select(
        F.col("o_orderkey").alias("path"), F.lit(0).alias("mtime_ns"), F.col("o_custkey").alias("size"), "o_orderstatus", "o_orderpriority"
    )
    cache = orders.filter("o_orderpriority = '5-LOW' or o_orderstatus = 'F'").select("path", "mtime_ns", "size")
    live = orders.filter("o_orderpriority <> '3-MEDIUM'")
    indexed = orders.filter("o_orderstatus = 'F'")
    found = orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'").withColumn("size", F.col("size") + 1)
    return N.remember_empty(cache, live, indexed, found).select("path", "size")


@query("seeded_empty", "I6", """
    SELECT seq AS path, seq * 2 AS size FROM vectors WHERE seq NOT IN (SELECT doc_id FROM labels)""", "vectors")
def _(t):
    semantic = t.vectors.select(F.col("seq").alias("path"))
    face = t.read("labels").select(F.col("doc_id").alias("path"))
    signatures = t.vectors.select(F.col("seq").alias("path"), F.lit(0).alias("mtime_ns"), (F.col("seq") * 2).alias("size"))
    return N.seed_empty(semantic, face, signatures).select("path", "size")


@query("manifest_round_trip", "A7", "SELECT path, seq FROM vectors", "vectors")
def _(t):
    out = scratch(t)
    VT.write_manifest(t.vectors, f"{out}/manifest")
    return VT.read_manifest(t.spark, f"{out}/manifest").select("path", "seq")


def readable_letter_counts():
    """Stand-in encoder that cannot read texts with a digit."""
    count = letter_counts()

    def encode(inputs: list) -> list:
        readable = [not any(c in "0123456789" for c in text) for text in inputs]
        return [v if ok else None for v, ok in zip(count(inputs), readable, strict=True)]

    return encode


@query("rebuilt_semantic_index", "H17 A5 A6 A11", f"""
    WITH v AS (SELECT doc_id, {_letters('text')} AS v FROM documents WHERE NOT regexp_matches(text, '[0-9]'))
    SELECT 'doc_' || doc_id AS path, doc_id AS seq, 'letters-1' AS model_id, generate_subscripts(v, 1)::BIGINT AS pos,
        round(unnest(list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-6))::FLOAT::DOUBLE)), 5) + 0.0 AS x
    FROM v WHERE list_sum(v) > 0""")
def _(t):
    out = scratch(t)
    manifest = t.read("documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("path"), F.col("doc_id").alias("seq"), "text")
    found = EN.valid_vectors(EN.embed(manifest, "path", "text", readable_letter_counts))
    nonzero = found.filter(F.exists("embedding", lambda x: x > 0)).join(manifest.select("path", "seq"), "path")
    VT.write_vectors(nonzero, f"{out}/vectors", "semantic", "letters-1", mode="overwrite")
    stored = VT.read_vectors(t.spark, f"{out}/vectors", "semantic", "letters-1")
    cells = stored.select("path", "seq", "model_id", F.posexplode("embedding").alias("p", "v"))
    return cells.select(
        "path", "seq", "model_id", (F.col("p") + 1).cast("long").alias("pos"), (F.round(F.col("v").cast("double"), 5) + 0.0).alias("x")
    )
