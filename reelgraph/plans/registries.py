"""Registry joins, counts, reconciliation and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.operators import registry as R
from reelgraph.plans.catalog import query
from reelgraph.plans.tables import scratch
from reelgraph.sources import vector_table as VT


@query("faces_with_names", "C6", """
    SELECT f.id, f.person_id, p.name FROM faces f LEFT JOIN persons p ON p.id = f.person_id""", "faces persons")
def _(t):
    return R.faces_with_names(t.faces, t.persons).select("id", "person_id", "name")


@query("face_gallery", "C7 D13", """
    SELECT f.person_id::VARCHAR AS person_id, f.thumbnail_path AS thumbnail, f.confidence, split_part(v.path, '/', -1) AS video
    FROM faces f JOIN videos v ON v.id = f.video_id""", "faces videos")
def _(t):
    return R.face_gallery(t.faces, t.videos)


@query("nested_face_gallery", "D13", """
    WITH g AS (SELECT coalesce(f.person_id::VARCHAR, 'None') AS person_id, f.id, f.confidence FROM faces f JOIN videos v ON v.id = f.video_id),
    c AS (SELECT *, (row_number() OVER (PARTITION BY person_id ORDER BY id) - 1) // 100 AS chunk FROM g)
    SELECT person_id, chunk, count(*) AS entries, round(sum(confidence), 6) AS confidence FROM c GROUP BY person_id, chunk""", "faces videos")
def _(t):
    nested = R.nested_gallery(t.faces, t.videos, chunk=100)
    total = F.aggregate(F.col("faces.confidence"), F.lit(0.0), lambda a, x: a + x)
    return nested.select("person_id", "chunk", F.size("faces").cast("long").alias("entries"), F.round(total, 6).alias("confidence"))


@query("persons_with_faces", "C8", """
    SELECT p.id, p.name, p.thumbnail, count(*) AS n FROM customers p JOIN event_faces f ON f.person_id = p.id GROUP BY ALL""",
    "customers event_faces")
def _(t):
    return R.persons_with_faces(t.customers, t.event_faces)


@query("face_distribution", "C9", """
    SELECT p.id, count(f.id) AS n FROM customers p LEFT JOIN event_faces f ON f.person_id = p.id GROUP BY p.id""",
    "customers event_faces")
def _(t):
    return R.face_distribution(t.customers, t.event_faces)


@query("person_videos", "C10", """
    SELECT DISTINCT v.path, v.label FROM videos v JOIN faces f ON f.video_id = v.id WHERE f.person_id = 7""", "videos faces")
def _(t):
    return R.person_videos(7, t.faces, t.videos)


@query("unindexed_files", "C11", """
    SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    path = F.col("doc_id").alias("path")
    return R.unindexed(t.read("documents").select(path), t.read("labels").select(path))


@query("unscanned_files", "C12 I6", """
    SELECT o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority NOT IN ('5-LOW')""")
def _(t):
    orders = t.read("orders")
    mtime, size = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000, F.col("o_custkey")
    files = orders.select(F.col("o_orderkey").alias("path"), mtime.alias("mtime_ns"), size.alias("size"))
    indexed = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    # Urgent files changed since they were found empty.
    old_size = F.when(F.col("o_orderpriority") == "1-URGENT", size + 1).otherwise(size)
    empty = orders.filter("o_orderpriority in ('5-LOW', '1-URGENT')").select(
        F.col("o_orderkey").alias("path"), mtime.alias("mtime_ns"), old_size.alias("size")
    )
    return R.unscanned(files, indexed, empty).select("path")


@query("indexed_labels", "C13", """
    WITH rows AS (SELECT path, arg_max(label, id) AS label FROM videos GROUP BY path),
    f AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'in/clip_' || c_custkey || '.avi'
              WHEN c_mktsegment = 'MACHINERY' THEN 'uploaded_videos/other_' || c_custkey || '.mkv'
              ELSE '/media/clip_' || c_custkey || '.mp4' END AS path FROM customer)
    SELECT f.path, r.label, r.path IS NOT NULL AS indexed
    FROM f LEFT JOIN rows r ON r.path = 'uploaded_videos/' || regexp_replace(split_part(f.path, '/', -1), '\\.[a-z0-9]+$', '.mp4')""", "videos")
def _(t):
    key = F.col("c_custkey")
    path = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("in/clip_"), key, F.lit(".avi")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("uploaded_videos/other_"), key, F.lit(".mkv")))
        .otherwise(F.concat(F.lit("/media/clip_"), key, F.lit(".mp4")))
    )
    return R.indexed_labels(t.read("customer").select(path.alias("path")), t.videos)


_ACTIONS = """
    actions AS (SELECT v.id, coalesce(split_part(v.path, '/', -1), split_part(f.path, '/', -1)) AS file_name, v.path AS old_path,
        f.path AS new_path, CASE WHEN f.path IS NULL THEN 'delete' WHEN v.id IS NULL THEN 'add'
            WHEN NOT v.has_vector OR v.label IN ('Processing AI tags...', 'unknown') OR NOT EXISTS (
                SELECT 1 FROM video_thumbs s WHERE s.stem || '.mp4' = split_part(v.path, '/', -1)) THEN 'requeue'
            WHEN v.path <> f.path THEN 'repoint' ELSE 'keep' END AS action
        FROM videos v FULL JOIN files f ON split_part(v.path, '/', -1) = split_part(f.path, '/', -1))"""


@query("reconcile_actions", "C14", f"WITH {_ACTIONS} SELECT * FROM actions", "videos files video_thumbs")
def _(t):
    return R.reconcile_videos(t.videos, t.files, t.video_thumbs)


@query("reconciled_videos", "C14", f"""
    WITH {_ACTIONS} SELECT id, new_path AS path FROM actions WHERE action NOT IN ('delete', 'add')""", "videos files video_thumbs")
def _(t):
    actions = R.reconcile_videos(t.videos, t.files, t.video_thumbs)
    return R.apply_reconciliation(actions, t.videos, t.faces, t.persons)[0].select("id", "path")


@query("reconciled_faces", "C14 C17", f"""
    WITH {_ACTIONS} SELECT id FROM faces WHERE video_id NOT IN (SELECT id FROM actions WHERE action = 'delete')""",
    "videos files video_thumbs faces")
def _(t):
    actions = R.reconcile_videos(t.videos, t.files, t.video_thumbs)
    return R.apply_reconciliation(actions, t.videos, t.faces, t.persons)[1].select("id")


@query("orphan_free_persons", "C17", """
    SELECT id, name FROM customers WHERE id IN (SELECT person_id FROM event_faces WHERE person_id IS NOT NULL)""",
    "customers event_faces")
def _(t):
    return R.without_orphans(t.customers, t.event_faces).select("id", "name")


@query("reconciled_photos", "C15", """
    SELECT 'manifest' AS part, path AS key FROM person_photos WHERE path IN (FROM live) GROUP BY path
    UNION ALL SELECT 'person_photos', person_id || ' ' || path || ' ' || min(seq) FROM person_photos WHERE path IN (FROM live) GROUP BY person_id, path
    UNION ALL SELECT 'people', person_id FROM people WHERE person_id IN (SELECT person_id FROM person_photos WHERE path IN (FROM live))
    UNION ALL SELECT 'vectors', 'photo_' || seq || '.jpg' FROM vectors WHERE 'photo_' || seq || '.jpg' IN (FROM live)""",
    "person_photos live people vectors")
def _(t):
    vectors = t.vectors.select(F.concat(F.lit("photo_"), F.col("seq"), F.lit(".jpg")).alias("path"), "seq")
    out = R.reconcile_photos(t.person_photos.select("path", "seq"), vectors, t.people, t.person_photos, t.live)
    keys = {"manifest": F.col("path"), "vectors": F.col("path"), "people": F.col("person_id"),
            "person_photos": F.concat_ws(" ", "person_id", "path", "seq")}
    parts = [out[name].select(F.lit(name).alias("part"), key.alias("key")) for name, key in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("duplicate_files", "C16 B19", """
    WITH named AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'p' || o_custkey || '_' || (1700000000000 + o_orderkey) || '.jpg'
                   ELSE 'p' || (o_custkey + o_orderkey) || '.jpg' END AS name, o_custkey, o_orderstatus FROM orders),
    d AS (SELECT name, 'p' || o_custkey || '.jpg' AS original FROM named WHERE o_orderstatus = 'F')
    SELECT name, original, CASE WHEN original IN (SELECT name FROM named) OR name <> min(name) OVER (PARTITION BY original)
        THEN 'remove' ELSE 'rename' END AS action FROM d""")
def _(t):
    stamped = F.concat(F.lit("p"), "o_custkey", F.lit("_"), F.lit(1700000000000) + F.col("o_orderkey"), F.lit(".jpg"))
    plain = F.concat(F.lit("p"), F.col("o_custkey") + F.col("o_orderkey"), F.lit(".jpg"))
    name = F.when(F.col("o_orderstatus") == "F", stamped).otherwise(plain)
    return R.duplicate_files(t.read("orders").select(F.concat(F.lit("test_images/"), name).alias("path")))


_TARGETS = """
    targets AS (SELECT c_custkey::VARCHAR AS target FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT '/old/clip_' || c_custkey || '.mp4' FROM customer WHERE c_mktsegment = 'FURNITURE'
        UNION ALL SELECT 'clip_' || c_custkey || '.mp4' FROM customer WHERE c_mktsegment = 'FURNITURE'),
    gone AS (SELECT id, path FROM videos WHERE id::VARCHAR IN (FROM targets)
             OR split_part(path, '/', -1) IN (SELECT split_part(target, '/', -1) FROM targets))"""


def _targets(t):
    key = F.col("c_custkey")
    building = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(key.cast("string").alias("target"))
    furniture = t.read("customer").filter("c_mktsegment = 'FURNITURE'")
    name = F.concat(F.lit("clip_"), key, F.lit(".mp4"))
    names = furniture.select(F.explode(F.array(F.concat(F.lit("/old/"), name), name)).alias("target"))
    return building.unionByName(names)


@query("deletion_targets", "C18", f"WITH {_TARGETS} SELECT * FROM gone", "videos")
def _(t):
    return R.deletion_targets(t.videos, _targets(t))


@query("faces_after_deletion", "H9", f"""
    WITH {_TARGETS} SELECT id FROM faces WHERE video_id NOT IN (SELECT id FROM gone)""", "videos faces")
def _(t):
    gone = R.deletion_targets(t.videos, _targets(t))
    return R.delete_videos(t.videos, t.faces, t.persons, gone)[1].select("id")


@query("videos_after_deletion", "H9 G4", f"""
    WITH {_TARGETS} SELECT id, path FROM videos WHERE id NOT IN (SELECT id FROM gone)""", "videos")
def _(t):
    gone = R.deletion_targets(t.videos, _targets(t))
    return R.delete_videos(t.videos, t.faces, t.persons, gone)[0].select("id", "path")


@query("vectors_with_paths", "C20", """
    SELECT seq, path, round(u[1], 6) + 0.0 AS first FROM vectors""", "vectors")
def _(t):
    zipped = R.zip_by_position(t.unit_vectors.select("seq", "embedding"), t.vectors.select("seq", "path"))
    return zipped.select("seq", "path", (F.round(F.element_at("embedding", 1), 6) + 0.0).alias("first"))


@query("registry_counts", "D7", """
    SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM videos) AS videos,
           (SELECT count(*) FROM embeddings) AS vectors""", "persons faces videos")
def _(t):
    return R.global_counts(persons=t.persons, faces=t.faces, videos=t.videos, vectors=t.vectors)


@query("faces_per_video", "D8", "SELECT video_id, count(*) AS n FROM faces GROUP BY video_id", "faces")
def _(t):
    return R.faces_per_video(t.faces)


@query("confidence_histogram", "D9", """
    SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n FROM faces GROUP BY 1""", "faces")
def _(t):
    return R.confidence_histogram(t.faces)


@query("video_fingerprint", "D15", """
    SELECT count(*) AS rows, max(id) AS max_id, 0::BIGINT AS frame_chars, sum(len(label))::BIGINT AS label_chars FROM videos""", "videos")
def _(t):
    row = R.fingerprint(t.videos)
    return row.select("rows", "max_id", F.col("frame_chars").cast("long").alias("frame_chars"), "label_chars")


_KEPT = "kept AS (SELECT min(id) AS id FROM videos GROUP BY path)"


@query("deduplicated_videos", "E4", f"WITH {_KEPT} SELECT id, path FROM videos WHERE id IN (FROM kept)", "videos")
def _(t):
    return R.deduplicate_videos(t.videos, t.faces, t.persons)[0].select("id", "path")


@query("deduplicated_faces", "E4", f"""
    WITH {_KEPT} SELECT id FROM faces WHERE video_id IN (FROM kept) OR video_id NOT IN (SELECT id FROM videos)""", "videos faces")
def _(t):
    return R.deduplicate_videos(t.videos, t.faces, t.persons)[1].select("id")


@query("deduplicated_persons", "E4 C17", f"""
    WITH {_KEPT} SELECT id FROM persons WHERE id IN (SELECT person_id FROM faces WHERE video_id IN (FROM kept)
        OR video_id NOT IN (SELECT id FROM videos))""", "videos faces persons")
def _(t):
    return R.deduplicate_videos(t.videos, t.faces, t.persons)[2].select("id")


def _unique_videos(t):
    return R.deduplicate_videos(t.videos, t.faces, t.persons)[0].withColumn("frames", F.lit(None).cast("binary"))


def _incoming(t):
    key = F.col("c_custkey")
    path = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("new/add_"), key, F.lit(".mp4"))).otherwise(
        F.concat(F.lit("new/clip_"), key, F.lit(".mp4"))
    )
    # Every customer sends a file; those of a segment send it twice, the later path counts.
    c = t.read("customer")
    again = c.filter("c_mktsegment = 'MACHINERY'").select(
        F.concat(F.lit("early/clip_"), F.col("c_custkey"), F.lit(".mp4")).alias("path"), F.lit("stale").alias("label"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("binary").alias("frames"),
    )
    return again.unionByName(c.select(
        path.alias("path"), F.lit("fresh").alias("label"), F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(None).cast("binary").alias("frames"),
    ))


_UPSERT = """
    base AS (SELECT * FROM videos WHERE id IN (SELECT min(id) FROM videos GROUP BY path)),
    fresh AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'new/add_' ELSE 'new/clip_' END || c_custkey || '.mp4' AS path
              FROM customer),
    hits AS (SELECT b.id, f.path FROM base b JOIN fresh f ON split_part(f.path, '/', -1) = split_part(b.path, '/', -1)),
    added AS (SELECT path FROM fresh WHERE path NOT IN (SELECT path FROM hits))"""


@query("upserted_videos", "H1", f"""
    WITH {_UPSERT} SELECT b.id, coalesce(h.path, b.path) AS path, CASE WHEN h.id IS NULL THEN b.label ELSE 'fresh' END AS label
    FROM base b LEFT JOIN hits h ON h.id = b.id
    UNION ALL SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY path), path, 'fresh' FROM added""", "videos")
def _(t):
    return R.upsert_videos(_unique_videos(t), _incoming(t), t.faces, t.persons)[0].select("id", "path", "label")


@query("faces_after_upsert", "H1", f"""
    WITH {_UPSERT} SELECT id FROM faces WHERE video_id NOT IN (SELECT id FROM hits)""", "videos faces")
def _(t):
    return R.upsert_videos(_unique_videos(t), _incoming(t), t.faces, t.persons)[1].select("id")


@query("updated_vectors", "H2", """
    SELECT id, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE label END AS label,
           CASE WHEN c_custkey IS NOT NULL THEN c_acctbal WHEN has_vector THEN o_totalprice END AS first,
           CASE WHEN c_acctbal > 0 THEN 1 ELSE 2 END::BIGINT AS frame_bytes
    FROM videos LEFT JOIN customer ON c_custkey = id""", "videos")
def _(t):
    videos = t.videos.withColumn("frames", F.encode(F.lit("ab"), "utf-8"))
    results = t.read("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.array("c_acctbal").alias("embedding"),
        F.when(F.col("c_acctbal") > 0, F.encode(F.lit("z"), "utf-8")).alias("frames"),
    )
    out = R.update_vectors(videos, results)
    return out.select("id", "label", F.element_at("embedding", 1).alias("first"), F.length("frames").cast("long").alias("frame_bytes"))


def _corrections(t):
    return t.read("customer").select(
        F.col("c_custkey").alias("video_id"), F.col("c_mktsegment").alias("corrected_label"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


@query("corrected_videos", "H3", """
    SELECT id, coalesce(c_mktsegment, label) AS label FROM videos LEFT JOIN customer ON c_custkey = id""", "videos")
def _(t):
    none = t.spark.createDataFrame([], "video_id long, corrected_label string, embedding array<double>, created_at timestamp")
    return R.correct_labels(t.videos, none, _corrections(t))[0].select("id", "label")


@query("learned_feedback", "H3 H4", """
    SELECT c_mktsegment AS corrected_label, o_totalprice AS first FROM videos JOIN customer ON c_custkey = id WHERE has_vector""", "videos")
def _(t):
    none = t.spark.createDataFrame([], "video_id long, corrected_label string, embedding array<double>, created_at timestamp")
    feedback = R.correct_labels(t.videos, none, _corrections(t))[1]
    return R.usable_feedback(feedback).select("corrected_label", F.element_at("embedding", 1).alias("first"))


@query("created_within", "H10", """
    SELECT event_id AS id FROM events WHERE date_trunc('second', ts) >= date_trunc('second', (SELECT max(ts) FROM events)) - INTERVAL 36 HOUR""")
def _(t):
    events = t.read("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    now = events.agg(F.max("created_at")).scalar()
    return R.created_within(events, 36, now).select("id")


@query("emptied_registry", "H11 H1", """
    SELECT row_number() OVER (ORDER BY path) AS id, path, 'fresh' AS label FROM (
        SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'new/add_' ELSE 'new/clip_' END || c_custkey || '.mp4' AS path FROM customer)""")
def _(t):
    videos = t.videos.withColumn("frames", F.lit(None).cast("binary"))
    empty = R.emptied(videos, t.faces, t.persons)
    filled = R.upsert_videos(empty[0], _incoming(t), empty[1], empty[2])[0]
    return filled.select(F.col("id").cast("long").alias("id"), "path", "label")


@query("ids_never_reused", "H1 H12", """
    WITH base AS (SELECT max(id) AS last FROM videos WHERE id IN (SELECT min(id) FROM videos GROUP BY path)),
    fresh AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'new/add_' ELSE 'new/clip_' END || c_custkey || '.mp4' AS path FROM customer)
    SELECT last + row_number() OVER (ORDER BY path) AS id, path FROM fresh, base""", "videos")
def _(t):
    videos = _unique_videos(t)
    meta = R.with_last_id(t.spark.createDataFrame([], "key string, value string"), videos)
    gone = R.delete_videos(videos, t.faces, t.persons, videos.select("id"))
    filled = R.upsert_videos(gone[0], _incoming(t), gone[1], gone[2], meta)[0]
    return filled.select(F.col("id").cast("long").alias("id"), "path")


@query("meta_upsert", "H12", """
    SELECT 'k' || p_partkey AS key, CASE WHEN p_type = 'ECONOMY' THEN p_name ELSE p_brand END AS value FROM part""")
def _(t):
    part = t.read("part")
    key = F.concat(F.lit("k"), "p_partkey").alias("key")
    old = part.filter("p_size > 10 or p_type <> 'ECONOMY'").select(key, F.col("p_brand").alias("value"))
    return R.set_meta(old, part.filter("p_type = 'ECONOMY'").select(key, F.col("p_name").alias("value")))


@query("linked_faces_added", "H13", """
    SELECT id, person_id, video_id FROM faces
    UNION ALL SELECT -event_id - 1, user_id, NULL FROM events""", "faces")
def _(t):
    new = t.read("events").select((-F.col("event_id") - 1).alias("id"), F.col("user_id").alias("person_id"))
    return R.add_face(t.faces, new).select("id", "person_id", "video_id")


@query("repointed_videos", "H14", """
    SELECT id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'converted/' || c_custkey || '.mp4' ELSE path END AS path
    FROM videos LEFT JOIN customer ON c_custkey = o_custkey""", "videos")
def _(t):
    key = F.col("c_custkey")
    moves = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("any/clip_"), key, F.lit(".mp4")).alias("old_path"), F.concat(F.lit("converted/"), key, F.lit(".mp4")).alias("new_path")
    )
    return R.repoint(t.videos, moves).select("id", "path")


@query("rebuilt_video_vectors", "H15", """
    SELECT id, o_totalprice AS first FROM videos WHERE has_vector""", "videos")
def _(t):
    return R.video_vectors(t.videos).select("id", F.element_at("embedding", 1).alias("first"))


@query("stale_model_paths", "H16", """
    SELECT DISTINCT path FROM vectors WHERE label >= 5""", "vectors")
def _(t):
    model = F.when(F.col("label") < 5, F.lit("clip-vit-b16-fp32")).when(F.col("label") < 8, F.lit(R.LEGACY_MODEL_ID))
    return R.split_by_model(t.vectors.withColumn("model_id", model), "clip-vit-b16-fp32")[1]


@query("stored_vectors", "A5 A6 H16", """
    SELECT seq, path, 'semantic' AS kind, CASE WHEN label < 5 THEN 'model-a' ELSE 'model-b' END AS model_id,
           round(list_dot_product(u, u), 4) AS squared FROM vectors""", "vectors")
def _(t):
    out = scratch(t)
    VT.write_vectors(t.vectors.filter("label < 5"), out, "semantic", "model-a", mode="overwrite")
    VT.write_vectors(t.vectors.filter("label >= 5"), out, "semantic", "model-b", mode="append")
    both = VT.read_vectors(t.spark, out, "semantic", "model-a").unionByName(VT.read_vectors(t.spark, out, "semantic", "model-b"))
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return both.select("seq", "path", "kind", "model_id", F.round(squared, 4).alias("squared"))


@query("renamed_people", "H5", """
    SELECT person_id, CASE WHEN n_name IS NOT NULL THEN n_name ELSE name END AS name
    FROM people LEFT JOIN nation ON person_id = 'Person_' || n_nationkey""", "people")
def _(t):
    renames = t.read("nation").select(F.concat(F.lit("Person_"), "n_nationkey").alias("person_id"), F.col("n_name").alias("new_name"))
    return R.rename_people(t.people, renames)


@query("renamed_video_people", "H5", """
    SELECT id, coalesce(n_name, name) AS name FROM persons LEFT JOIN nation ON n_nationkey = id""", "persons")
def _(t):
    renames = t.read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("new_name"))
    return R.rename_people(t.persons, renames, "id").select("id", "name")


_REMOVED = "removed AS (SELECT DISTINCT path FROM person_photos WHERE path NOT IN (FROM live))"


def _removed(t):
    return t.person_photos.select("path").join(t.live, "path", "left_anti").distinct()


@query("people_after_removal", "H6", f"""
    WITH {_REMOVED} SELECT person_id FROM people WHERE person_id NOT IN (
        SELECT person_id FROM person_photos GROUP BY person_id HAVING bool_and(path IN (FROM removed)))""", "person_photos live people")
def _(t):
    return R.remove_photos(t.people, t.person_photos, _removed(t))[0].select("person_id")


@query("photos_after_removal", "H6", """
    SELECT person_id, path, seq FROM person_photos WHERE path IN (FROM live)""", "person_photos live")
def _(t):
    return R.remove_photos(t.people, t.person_photos, _removed(t))[1]


@query("stale_people_counts", "H7", """
    WITH a AS (SELECT person_id IN (SELECT person_id FROM person_photos WHERE path IN (FROM live)) AS alive FROM people)
    SELECT count(*) FILTER (NOT alive) AS removed, count(*) FILTER (alive) AS remaining FROM a""", "person_photos live people")
def _(t):
    return R.remove_stale_people(t.people, t.person_photos, t.live)[1]


@query("live_people", "H7", """
    SELECT person_id, name FROM people WHERE person_id IN (SELECT person_id FROM person_photos WHERE path IN (FROM live))""",
    "person_photos live people")
def _(t):
    return R.remove_stale_people(t.people, t.person_photos, t.live)[0].select("person_id", "name")


@query("tables_after_photo_deletion", "H8", f"""
    WITH {_REMOVED} SELECT 'manifest' AS part, path AS key FROM person_photos WHERE path IN (FROM live)
    UNION ALL SELECT 'vectors', 'photo_' || seq || '.jpg' FROM vectors WHERE 'photo_' || seq || '.jpg' NOT IN (FROM removed)
    UNION ALL SELECT 'people', person_id FROM people WHERE person_id NOT IN (
        SELECT person_id FROM person_photos GROUP BY person_id HAVING bool_and(path IN (FROM removed)))
    UNION ALL SELECT 'person_photos', person_id || ' ' || path FROM person_photos WHERE path IN (FROM live)""", "person_photos live people vectors")
def _(t):
    vectors = t.vectors.select(F.concat(F.lit("photo_"), F.col("seq"), F.lit(".jpg")).alias("path"))
    out = R.delete_photos(t.person_photos.select("path"), vectors, t.people, t.person_photos, _removed(t))
    keys = {"manifest": "path", "vectors": "path", "people": "person_id", "person_photos": F.concat_ws(" ", "person_id", "path")}
    parts = [out[n].select(F.lit(n).alias("part"), (F.col(k) if isinstance(k, str) else k).alias("key")) for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


