"""The library views: unions, first-seen rows, tags, dates, paging, selections, people lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions.text import mtime_date
from reelgraph.operators import library as L
from reelgraph.operators import progress as P
from reelgraph.operators.ranking import with_row_number
from reelgraph.operators.registry import persons_with_faces
from reelgraph.plans.catalog import query


def _photos(t):
    return t.read("pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"), F.col("page_id").alias("seq"))


def _clips(t):
    d = t.read("documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").alias("seq"))


@query("combined_media", "G1 E5", """
    SELECT page_id::VARCHAR AS id, url AS path, 'photo' AS media_type FROM pages
    UNION ALL SELECT min(doc_id)::VARCHAR, source || '/' || lang, 'video' FROM documents GROUP BY source, lang""")
def _(t):
    return L.combined_media(_photos(t), _clips(t)).select("id", "path", "media_type")


@query("first_of_each_title", "E5", """
    SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""")
def _(t):
    orders = t.read("orders").select(F.col("o_custkey").cast("string").alias("title"), "o_orderdate", "o_orderkey")
    firsts = L.first_per_key(orders, "title", "o_orderdate", "o_orderkey")
    return firsts.select(F.col("title").cast("long").alias("c_custkey"), "o_orderkey")


@query("person_media", "C21", """
    WITH mine AS (SELECT DISTINCT split_part(path, '/', -1) AS name FROM person_photos WHERE person_id = 'Person_7'),
    media AS (SELECT CASE WHEN page_id < 50 THEN 'library/photo_' ELSE 'photo_' END || page_id || '.jpg' AS path FROM pages)
    SELECT path FROM media WHERE split_part(path, '/', -1) IN (FROM mine)""", "person_photos")
def _(t):
    folder = F.when(F.col("page_id") < 50, F.lit("library\\photo_")).otherwise(F.lit("photo_"))
    path = F.concat(folder, F.col("page_id"), F.lit(".jpg"))
    media = t.read("pages").select(path.alias("path"), path.alias("id"))
    mine = t.person_photos.filter("person_id = 'Person_7'").select("path")
    return L.person_media(media, mine).select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path"))


@query("top_tags", "D10", """
    WITH tags AS (SELECT lower(lang) AS tag FROM documents UNION ALL SELECT lower(source) FROM documents)
    SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 14""")
def _(t):
    label = F.concat(F.upper("lang"), F.lit(", "), F.col("source"), F.lit(", , Processing AI tags..."))
    return L.tag_counts(t.read("documents").select(label.alias("label")))


@query("all_tags", "D10", """
    WITH tags AS (SELECT lower(lang) AS tag FROM documents UNION ALL SELECT lower(source) FROM documents)
    SELECT tag, count(*) AS n FROM tags GROUP BY tag""")
def _(t):
    label = F.concat(F.upper("lang"), F.lit(", "), F.col("source"))
    return L.tag_counts(t.read("documents").select(label.alias("label")), None)


@query("videos_with_tag", "D11", "SELECT id FROM videos WHERE label = '2-HIGH, Clip'", "videos")
def _(t):
    return L.with_tag(t.videos, "2-high").select("id")


@query("items_per_date", "D17", """
    SELECT CASE WHEN event_type = 'error' THEN 'Recent' ELSE strftime(ts, '%Y-%m-%d') END AS date, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    date = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd"))
    return L.by_date(t.read("events").select(date.alias("date")))


@query("grid_rows", "E8", """
    WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS date,
               row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS p FROM events)
    SELECT event_id, date, p // 5 AS row, p % 5 AS col FROM p""")
def _(t):
    media = t.read("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return L.grid_rows(media, order="event_id")


@query("library_page", "E6", """
    SELECT event_id, ts::VARCHAR AS ts FROM events ORDER BY events.ts, event_id LIMIT 1000 OFFSET 1000""")
def _(t):
    rows = L.page(t.read("events").select("event_id", "ts"), 1000, 1000, "ts", "event_id")
    return rows.select("event_id", F.col("ts").cast("string").alias("ts"))


@query("nth_video", "E7", "SELECT id, path, label FROM videos ORDER BY id LIMIT 1 OFFSET 137", "videos")
def _(t):
    return L.nth_by_id(t.videos, 137).select("id", "path", "label")


@query("selected_range", "E9", """
    WITH o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)
    SELECT id FROM o WHERE seq BETWEEN (SELECT min(seq) FROM o WHERE id IN (900, 40)) AND (SELECT max(seq) FROM o WHERE id IN (900, 40))""")
def _(t):
    items = t.read("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    ordered = with_row_number(items, "o_orderdate", "id", name="seq")
    return L.select_range(ordered, 900, 40).select("id")


@query("exported_selection", "A13", """
    SELECT c.c_custkey AS id, o.o_orderkey AS sel_ord FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    WHERE c.c_mktsegment <> 'BUILDING' ORDER BY o.o_orderkey LIMIT 25""")
def _(t):
    src = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("/media/"), F.col("c_custkey")))
    items = t.read("customer").select(F.col("c_custkey").alias("id"), src.alias("src"))
    selected = t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("sel_ord"))
    return L.export_selection(items, selected).select("id", "sel_ord")


@query("remaining_items", "G4", """
    SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(t):
    removed = t.read("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = L.without(t.read("lineitem"), removed, "l_orderkey")
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("pruned_cache", "G5 I6", """
    SELECT doc_id AS path FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT page_id FROM pages)""")
def _(t):
    return L.cached_live_unindexed(
        t.read("labels").select(F.col("doc_id").alias("path")), t.read("documents").select(F.col("doc_id").alias("path")),
        t.read("pages").select(F.col("page_id").alias("path")),
    )


@query("media_counts", "D16", """
    SELECT count(*) FILTER (event_type IN ('view', 'click')) AS photos, count(*) FILTER (event_type = 'purchase') AS videos FROM events""")
def _(t):
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "image").when(
        F.col("event_type") == "purchase", "video"
    )
    return L.media_counts(t.read("events").select(kind.alias("media_type")))


@query("merged_results", "G3", """
    SELECT user_id AS query_id, event_id AS id, value AS score, 'photo' AS media_type FROM events WHERE event_type IN ('view', 'error')
    UNION ALL SELECT user_id, event_id, value, 'video' FROM events WHERE event_type NOT IN ('view', 'error')""")
def _(t):
    hits = t.read("events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"), "event_type")
    photo = F.col("event_type").isin("view", "error")
    photos, videos = (hits.filter(side).drop("event_type") for side in (photo, ~photo))
    return L.merged_results(photos, videos)


@query("people_summary", "D14", """
    WITH alive AS (SELECT person_id, count(*) AS photo_count, arg_min(path, seq) AS preview_photo
        FROM person_photos WHERE path IN (FROM live) GROUP BY person_id)
    SELECT person_id, CASE WHEN name IS NULL OR name = 'Unknown' THEN 'Person ' || (substr(person_id, 8)::BIGINT + 1) ELSE name END AS name,
        photo_count, preview_photo FROM alive JOIN people USING (person_id)""", "person_photos live people")
def _(t):
    return L.people_summary(t.people, t.person_photos, t.live)


@query("live_person_photos", "E6 D14", """
    SELECT path, seq FROM person_photos WHERE person_id = 'Person_12' AND path IN (FROM live)""", "person_photos live")
def _(t):
    return L.live_person_photos(t.person_photos, t.live, "Person_12").select("path", "seq")


_PEOPLE = """
    photo_people AS (SELECT person_id, count(*) AS photo_count FROM person_photos WHERE path IN (FROM live) GROUP BY person_id),
    named AS (SELECT person_id, photo_count, CASE WHEN name IS NULL OR name = 'Unknown' THEN 'Person ' || (substr(person_id, 8)::BIGINT + 1)
              ELSE name END AS name FROM photo_people JOIN people USING (person_id)),
    video_people AS (SELECT p.id, p.name, count(*) AS n FROM persons p JOIN faces f ON f.person_id = p.id GROUP BY ALL)"""


def _video_people(t):
    return persons_with_faces(t.persons, t.faces)


@query("people_page", "G2 B29", f"""
    WITH {_PEOPLE}, first AS (SELECT * FROM named ORDER BY photo_count DESC, person_id LIMIT 60)
    SELECT 'photo_' || person_id AS id, 'photo' AS source, name, photo_count AS n FROM first
    UNION ALL SELECT 'video_' || id, 'video', coalesce(name, 'Person #' || id), n FROM video_people""",
    "person_photos live people persons faces")
def _(t):
    return L.people_page(L.people_summary(t.people, t.person_photos, t.live), _video_people(t), 0, 60)


@query("people_total", "G2", f"""
    WITH {_PEOPLE} SELECT (SELECT count(*) FROM named) + (SELECT count(*) FROM video_people) AS total""",
    "person_photos live people persons faces")
def _(t):
    return L.people_total(L.people_summary(t.people, t.person_photos, t.live), _video_people(t))


@query("photo_dates", "B21 E6", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date FROM events")
def _(t):
    return t.read("events").select(F.col("event_id").alias("id"), mtime_date(F.unix_timestamp("ts")).alias("date"))


# ---------------------------------------------------------------- progress


@query("job_progress", "E11", """
    WITH e AS (SELECT user_id AS job, event_id AS seq, row_number() OVER w AS processed,
                      epoch(ts) - epoch(first_value(ts) OVER w) AS elapsed, count(*) OVER (PARTITION BY user_id) AS total
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT job, seq, processed, round(100.0 * processed / total, 6) AS percent, round(elapsed / processed, 6) AS mean_seconds,
           round(elapsed / processed * (total - processed), 4) AS eta_seconds FROM e""")
def _(t):
    events = t.read("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    totals = events.groupBy("job").agg(F.count(F.lit(1)).alias("total"))
    return P.job_progress(events, totals).select(
        "job", "seq", "processed", F.round("percent", 6).alias("percent"), F.round("mean_seconds", 6).alias("mean_seconds"),
        F.round("eta_seconds", 4).alias("eta_seconds"),
    )


_RATES = """
    WITH o AS (SELECT user_id AS job, list(1 / value ORDER BY event_id) AS rates FROM events WHERE value > 0 GROUP BY user_id),
    a AS (SELECT job, list_reduce(rates, lambda a, x: 0.7 * a + 0.3 * x) AS rate, len(rates) AS n FROM o)"""


def observations(t):
    return t.read("events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.lit(1).alias("items"), F.col("value").alias("seconds")
    )


@query("throughput_average", "E12", _RATES + " SELECT job, round(rate, 6) AS rate, n FROM a")
def _(t):
    return P.throughput_average(observations(t)).select("job", F.round("rate", 6).alias("rate"), "n")


@query("images_per_second", "E12 B9", _RATES + " SELECT job, CASE WHEN n >= 3 THEN round(rate, 6) ELSE 4.0 END::DOUBLE AS rate FROM a")
def _(t):
    return P.images_per_second(P.throughput_average(observations(t))).select("job", F.round("rate", 6).alias("rate"))
