"""Similarity queries again with small parts and heads, so that the layouts for large tables run on small ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.operators import clustering as C
from reelgraph.operators import identity as I
from reelgraph.operators import search as S
from reelgraph.plans import clusters, people, searches  # noqa: F401  (their queries come first)
from reelgraph.plans.catalog import CATALOG, Entry
from reelgraph.plans.tables import Tables

ROWS = 64  # rows of a part


def again(of: str, name: str):
    """Register ``fn(tables)`` as ``name`` with the SQL of query ``of``."""

    def add(fn: Callable[[Tables], DataFrame]):
        first = CATALOG[of]
        CATALOG[name] = Entry(name, first.covers, lambda spark, sf_dir: fn(Tables(spark, sf_dir)), first.sql)
        return fn

    return add


@again("knn_join", "knn_join_chunked")
def _(t):
    found = S.knn(t.vectors.withColumnRenamed("seq", "query_id"), t.vectors, 10, broadcast_bytes=0, part_rows=ROWS)
    return found.select("query_id", "id", searches.r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@again("video_search", "video_search_chunked")
def _(t):
    found = S.video_search(t.label_queries, t.frames, broadcast_bytes=0, part_rows=4)
    return found.select("query_id", "id", searches.r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@again("similar_pairs", "similar_pairs_chunked")
def _(t):
    pairs = C.similar_pairs(t.vectors, 0.35, block_rows=ROWS)
    return pairs.select("src", "dst", F.round("sim", 6).alias("sim"))


@again("connected_components", "connected_components_chunked")
def _(t):
    return C.similarity_components(t.vectors, 0.40, block_rows=ROWS)


@again("leader_clusters", "leader_clusters_small_heads")
def _(t):
    return C.greedy_leader_clusters(t.vectors, 0.35, chunk_rows=16, task_rows=32, broadcast_bytes=0)


@again("duplicate_faces", "duplicate_faces_small_heads")
def _(t):
    return I.duplicate_faces(people.faces(t), 0.25, chunk_rows=32, large_rows=50)


@again("best_person", "best_person_chunked")
def _(t):
    faces = people.faces(t)
    known = I.known_people(faces.filter("person_id < 5"))
    found = I.best_person(faces.filter("person_id >= 5"), known, broadcast_bytes=0)
    return found.select("id", "person_id", F.round("sim", 6).alias("sim"))
