"""Faces and persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.operators import identity as I
from reelgraph.operators.linking import link_faces_in_order
from reelgraph.plans.catalog import query
from reelgraph.plans.clusters import COMPONENT_SQL, PAIR_SQL, TWO_STAGE_SQL

# Vectors as faces: label is the person, confidence and yaw come from the id.
_FACES = """
    vfaces AS (SELECT seq AS id, seq // 14 AS video_id, label::BIGINT AS person_id, 'face_' || seq || '.jpg' AS thumbnail_path,
               (seq % 100) / 100.0::DOUBLE AS confidence,
               CASE WHEN seq % 11 = 0 THEN NULL ELSE (seq * 37 % 181 - 90)::DOUBLE END AS pose_yaw FROM vectors)"""


def _faces(t):
    seq = F.col("seq")
    return t.vectors.select(
        seq.alias("id"), F.expr("seq div 14").alias("video_id"), F.col("label").cast("long").alias("person_id"), "embedding",
        F.concat(F.lit("face_"), seq, F.lit(".jpg")).alias("thumbnail_path"), ((seq % 100) / 100.0).alias("confidence"),
        F.when(seq % 11 != 0, (seq * 37 % 181 - 90).cast("double")).alias("pose_yaw"),
    )


@query("known_people", "F9 B1", "SELECT label::BIGINT AS person_id, round(u[1], 6) + 0.0 AS first FROM vectors", "vectors")
def _(t):
    return I.known_people(_faces(t)).select("person_id", (F.round(F.element_at("embedding", 1), 6) + 0.0).alias("first"))


_BEST = """
    best AS (SELECT f.seq AS id, p.label::BIGINT AS person_id, list_dot_product(f.u, p.u) AS sim,
             row_number() OVER (PARTITION BY f.seq ORDER BY list_dot_product(f.u, p.u) DESC, p.label) AS r
             FROM vectors f, vectors p WHERE f.label >= 5 AND p.label < 5)"""


@query("best_person", "C5", f"""
    WITH {_BEST} SELECT v.seq AS id, b.person_id, round(b.sim, 6) AS sim
    FROM vectors v LEFT JOIN best b ON b.id = v.seq AND b.r = 1 AND b.sim >= 0.32 WHERE v.label >= 5""", "vectors")
def _(t):
    faces = _faces(t)
    found = I.best_person(faces.filter("person_id >= 5"), I.known_people(faces.filter("person_id < 5")))
    return found.select("id", "person_id", F.round("sim", 6).alias("sim"))


@query("majority_names", "D3", """
    WITH v AS (SELECT o_custkey AS cluster, o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT cluster, arg_min(name, (-n, name)) AS name FROM v GROUP BY cluster""")
def _(t):
    name = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return I.majority_names(t.read("orders").select(F.col("o_custkey").alias("cluster"), name.alias("name")))


@query("best_thumbnails", "D4 B16", """
    SELECT person_id AS cluster, arg_max(thumbnail_path, (coalesce(confidence, 0) - abs(coalesce(pose_yaw, 0)) / 180.0 * 0.2, -id)) AS thumbnail
    FROM faces GROUP BY person_id""", "faces")
def _(t):
    return I.best_thumbnails(t.faces, "person_id").withColumnRenamed("person_id", "cluster")


_REBUILT = f"""
    {_FACES}, {COMPONENT_SQL},
    placed AS (SELECT seq AS id, dense_rank() OVER (ORDER BY component) AS person FROM components),
    members AS (SELECT p.person, f.*, CASE WHEN s.name IS NOT NULL THEN s.name END AS name
                FROM placed p JOIN vfaces f USING (id) LEFT JOIN persons s ON s.id = f.person_id),
    votes AS (SELECT person, name, count(*) AS n FROM members WHERE name IS NOT NULL GROUP BY ALL)"""


@query("rebuilt_persons", "F6 D3 D4", f"""
    WITH {_REBUILT}
    SELECT m.person AS id, (SELECT arg_min(v.name, (-v.n, v.name)) FROM votes v WHERE v.person = m.person) AS name,
           arg_max(m.thumbnail_path, (m.confidence - abs(coalesce(m.pose_yaw, 0)) / 180.0 * 0.2, -m.id)) AS thumbnail
    FROM members m GROUP BY m.person""", "vectors persons")
def _(t):
    return I.rebuild_video_people(_faces(t), t.persons, 0.40)[0]


@query("rebuilt_faces", "F6", f"""
    WITH {_REBUILT} SELECT id, person AS person_id FROM placed""", "vectors persons")
def _(t):
    return I.rebuild_video_people(_faces(t), t.persons, 0.40)[1].select("id", "person_id")


@query("photos_per_person", "D12", """
    SELECT 'Person_' || user_id AS person_id, props AS path, min(event_id) AS seq FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def _(t):
    label = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("user_id"))
    return I.photos_per_person(t.read("events").select(label.alias("label"), F.col("props").alias("path"), F.col("event_id").alias("seq")))


def _labelled(t):
    # Clicks name a person, other events the one a few numbers on.
    return t.read("events").select(
        F.when(F.col("event_type") == "click", F.col("user_id")).otherwise(F.col("user_id") + 7).alias("label"), F.col("props").alias("path"), F.col("event_id").alias("seq")
    )


@query("saved_people", "D12 B24", """
    SELECT person_id, CASE WHEN (name IS NULL OR name = 'Unknown') AND person_id IN (
        SELECT 'Person_' || CASE event_type WHEN 'click' THEN user_id ELSE user_id + 7 END FROM events) THEN 'Person ' || (substr(person_id, 8)::BIGINT + 1) ELSE name END AS name
    FROM people""", "people")
def _(t):
    return I.save_people(t.people, t.person_photos, _labelled(t))[0]


@query("saved_photos", "D12", """
    WITH old AS (SELECT person_id, path, min(seq) AS seq FROM person_photos GROUP BY ALL),
    new AS (SELECT 'Person_' || CASE event_type WHEN 'click' THEN user_id ELSE user_id + 7 END AS person_id, props AS path, min(event_id) AS seq FROM events GROUP BY ALL),
    last AS (SELECT person_id, max(seq) AS l FROM person_photos GROUP BY person_id)
    FROM old UNION ALL SELECT person_id, path, seq + coalesce(l + 1, 0) FROM new LEFT JOIN last USING (person_id)""", "person_photos")
def _(t):
    return I.save_people(t.people, t.person_photos, _labelled(t))[1]


@query("rebuilt_photo_people", "F5", f"""
    WITH {TWO_STAGE_SQL} SELECT 'Person_' || label AS person_id, 'item_' || seq || '.jpg' AS path, seq, 'Person ' || (label + 1) AS name
    FROM labelled""", "vectors elements")
def _(t):
    people, photos = I.rebuild_photo_people(t.vectors, threshold=0.35, merge_threshold=0.30)
    return photos.join(people, "person_id")


@query("duplicate_faces", "F7", f"""
    WITH {PAIR_SQL},
    near AS (SELECT v.seq, coalesce(list(p.src) FILTER (p.src IS NOT NULL), []) AS ahead
             FROM vectors v LEFT JOIN pairs p ON p.dst = v.seq AND p.la = p.lb AND p.sim > 0.25 GROUP BY v.seq),
    walk AS (SELECT 0::BIGINT AS i, [0::BIGINT] AS kept
        UNION ALL /* step */
        SELECT w.i + 1, CASE WHEN list_has_any(w.kept, n.ahead) THEN w.kept ELSE list_append(w.kept, w.i + 1) END
        FROM walk w JOIN near n ON n.seq = w.i + 1)
    SELECT seq AS id FROM vectors WHERE seq NOT IN (SELECT unnest(kept) FROM walk WHERE i = (SELECT max(i) FROM walk))""", "vectors")
def _(t):
    return I.duplicate_faces(_faces(t), 0.25)


_LINK = f"""
    {_FACES}, {_BEST}, {PAIR_SQL},
    good AS (SELECT id, video_id, confidence FROM vfaces WHERE person_id >= 5 AND confidence >= 0.35
             AND (pose_yaw IS NULL OR abs(pose_yaw) <= 75)),
    matched AS (SELECT g.id, g.video_id, b.person_id FROM good g LEFT JOIN best b ON b.id = g.id AND b.r = 1 AND b.sim >= 0.32),
    pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM matched WHERE person_id IS NULL),
    near AS (SELECT a.i, a.id, coalesce(list(b.id) FILTER (b.id IS NOT NULL), []) AS ahead
             FROM pool a LEFT JOIN (pairs p JOIN pool b ON b.id = p.src) ON p.dst = a.id AND p.sim >= 0.32 GROUP BY a.i, a.id),
    walk AS (SELECT 0::BIGINT AS i, [(SELECT min(id) FROM pool)] AS leaders
        UNION ALL /* step */
        SELECT w.i + 1, CASE WHEN list_has_any(w.leaders, n.ahead) THEN w.leaders ELSE list_append(w.leaders, n.id) END
        FROM walk w JOIN near n ON n.i = w.i + 1),
    leaders AS (SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT max(i) FROM walk)),
    joined AS (SELECT p.dst AS id, p.src AS leader, row_number() OVER (PARTITION BY p.dst ORDER BY p.sim DESC, p.src) AS r
               FROM pairs p WHERE p.src IN (FROM leaders) AND p.dst IN (SELECT id FROM pool) AND p.dst NOT IN (FROM leaders)),
    groups AS (SELECT id, leader FROM joined WHERE r = 1 UNION ALL SELECT leader, leader FROM leaders),
    fresh AS (SELECT id, 99 + dense_rank() OVER (ORDER BY leader) AS person_id FROM groups),
    linked AS (SELECT m.id, m.video_id, coalesce(m.person_id, f.person_id) AS person_id FROM matched m LEFT JOIN fresh f USING (id)),
    once AS (SELECT *, row_number() OVER (PARTITION BY video_id, person_id ORDER BY id) AS r FROM linked)"""


def detections(t):
    seen = _faces(t).filter("person_id >= 5")
    return seen.select(
        F.col("id").alias("det_id"), "video_id", F.col("confidence").alias("det_score"), F.col("pose_yaw").alias("yaw"),
        F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(40).alias("x2"), F.lit(40).alias("y2"), F.lit(20.0).alias("blur_var"),
        "embedding",
    )


@query("linked_faces", "F8 B13 C5", f"""
    WITH {_LINK} SELECT id, video_id, person_id FROM once WHERE r = 1""", "vectors")
def _(t):
    linked, _ = I.link_faces(detections(t), _faces(t).filter("person_id < 5"), 100)
    return linked.select(F.col("det_id").alias("id"), "video_id", "person_id")


@query("new_persons", "F8", f"WITH {_LINK} SELECT DISTINCT person_id AS id FROM fresh", "vectors")
def _(t):
    _, persons = I.link_faces(detections(t), _faces(t).filter("person_id < 5"), 100)
    return persons.select("id")


# Detection after detection: the nearest that it sees (stored, or of its video), the registry first among equals.
ORDER_SQL = f"""
    {_FACES}, {_BEST}, {PAIR_SQL},
    good AS (SELECT id, video_id, row_number() OVER (ORDER BY id) AS i FROM vfaces WHERE person_id >= 5 AND confidence >= 0.35
             AND (pose_yaw IS NULL OR abs(pose_yaw) <= 75)),
    near AS (SELECT g.i, g.id, g.video_id, b.person_id AS known, b.sim,
                 coalesce(list({{'s': p.sim, 'i': a.i, 'same': a.video_id = g.video_id}} ORDER BY p.sim DESC, a.i) FILTER (a.i IS NOT NULL), []) AS ahead
             FROM good g LEFT JOIN best b ON b.id = g.id AND b.r = 1 AND b.sim >= 0.32
                 LEFT JOIN (pairs p JOIN good a ON a.id = p.src) ON p.dst = g.id AND p.sim >= 0.32 GROUP BY ALL),
    walk AS (
        SELECT 0::BIGINT AS i, []::BIGINT[] AS persons, []::BOOLEAN[] AS stored, []::VARCHAR[] AS linked, 100::BIGINT AS next
        UNION ALL /* step */
        SELECT i, list_append(persons, p), list_append(stored, NOT list_contains(linked, key)), list_append(linked, key), next + (p = next)::BIGINT
        FROM (
            SELECT *, video_id || '/' || p AS key FROM (
                SELECT *, CASE WHEN c.s > coalesce(sim, -1) THEN persons[c.i] WHEN sim IS NOT NULL THEN known ELSE next END AS p
                FROM (SELECT n.*, w.persons, w.stored, w.linked, w.next, list_filter(n.ahead, lambda x: x.same OR w.stored[x.i])[1] AS c
                      FROM walk w JOIN near n ON n.i = w.i + 1)))),
    done AS (SELECT unnest(persons) AS person_id, unnest(stored) AS stored, generate_subscripts(persons, 1) AS i
             FROM walk WHERE i = (SELECT max(i) FROM walk))"""


@query("linked_faces_in_order", "F8 B13 C5", f"""
    WITH {ORDER_SQL} SELECT id, video_id, person_id FROM done JOIN good USING (i) WHERE stored""", "vectors")
def _(t):
    linked, _, _ = link_faces_in_order(detections(t), _faces(t).filter("person_id < 5"), 100)
    return linked.select(F.col("det_id").alias("id"), "video_id", "person_id")


@query("linked_faces_by_heads", "F8", f"""
    WITH {ORDER_SQL} SELECT id, video_id, person_id, stored FROM done JOIN good USING (i)""", "vectors")
def _(t):
    # Groups of more than a few rows go on in heads, as a person with millions of faces does.
    _, _, seen = link_faces_in_order(detections(t), _faces(t).filter("person_id < 5"), 100, task_rows=64, broadcast_bytes=0)
    return seen.select(F.col("det_id").alias("id"), "video_id", "person_id", "stored")


@query("new_persons_in_order", "F8", f"""
    WITH {ORDER_SQL} SELECT DISTINCT person_id AS id FROM done WHERE person_id >= 100""", "vectors")
def _(t):
    return link_faces_in_order(detections(t), _faces(t).filter("person_id < 5"), 100)[1].select("id")


faces = _faces
