"""Scalar columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions import media as M
from reelgraph.functions import text as X
from reelgraph.operators import frames as FR
from reelgraph.operators import identity as I
from reelgraph.operators import labeling as L
from reelgraph.operators.registry import faces_to_clean
from reelgraph.plans.catalog import query
from reelgraph.sources import files as SF


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query("clean_queries", "B3", r"""
    WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN chr(9) || text || chr(10) WHEN 1 THEN ' ' || chr(10) || chr(160) ELSE text END AS text
               FROM conversations),
    s AS (SELECT conv_id, turn, lower(regexp_replace(text, '^[\s\x0B\x{A0}]+|[\s\x0B\x{A0}]+$', '', 'g')) AS text FROM q)
    SELECT conv_id, turn, md5(text) AS digest FROM s WHERE text <> ''""")
def _(t):
    # A third of the queries stands between a tab and a line end, another third is white space alone.
    text = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\t"), "text", F.lit("\n")))
        .when(F.col("turn") % 3 == 1, F.lit(" \n\u00a0")).otherwise(F.col("text"))
    )
    rows = t.read("conversations").withColumn("text", text)
    return X.clean_queries(rows).select("conv_id", "turn", F.md5("text").alias("digest"))


_PROMPT_SQL = r"""
    WITH q AS (SELECT p_partkey * 4 AS query_id, ' ' || chr(9) || p_name || chr(10) AS text FROM part UNION ALL SELECT p_partkey * 4 + 1, p_type FROM part
        UNION ALL SELECT p_partkey * 4 + 2, 'A photo of ' || p_name FROM part
        UNION ALL SELECT p_partkey * 4 + 3, upper(p_name) FROM part),
    s AS (SELECT query_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM q),
    w AS (SELECT query_id, q, left(q, 1) AS c FROM s),
    a AS (SELECT *, CASE WHEN lower(c) IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || q AS aq FROM w),
    l AS (SELECT query_id, CASE
        WHEN lower(q) LIKE 'a photo of%' OR lower(q) LIKE 'a picture of%' THEN [q]
        WHEN NOT contains(q, ' ') THEN [q, 'a photo of ' || aq, 'a photograph of ' || aq, 'a picture of ' || aq,
            'a close-up photo of ' || aq, 'a photo of the ' || q, 'a photo of ' || q]
        WHEN upper(c) = c THEN [q, 'a photo of ' || q, 'a photograph of ' || q, 'a picture showing ' || q, 'an image of ' || q]
        ELSE [q, 'a photo of ' || q, 'a photograph of ' || q, 'a picture showing ' || q, 'an image of ' || q, 'a photo of ' || aq]
        END AS l FROM a)"""


def part_queries(t):
    # A small file of many short rows has few splits, and each row becomes 19 prompts or so: rows are dealt out before.
    p = t.read("part").select("p_partkey", "p_name", "p_type").repartition(t.spark.sparkContext.defaultParallelism)
    texts = F.array(
        F.concat(F.lit(" \t"), "p_name", F.lit("\n")), F.col("p_type"), F.concat(F.lit("A photo of "), "p_name"), F.upper("p_name")
    )
    rows = p.select("p_partkey", F.posexplode(texts).alias("i", "text"))
    return rows.select((F.col("p_partkey") * 4 + F.col("i")).alias("query_id"), "text")


@query("prompt_templates", "B4", _PROMPT_SQL + """
    SELECT query_id, unnest(l) AS prompt, generate_subscripts(l, 1)::BIGINT - 1 AS prompt_no FROM l""")
def _(t):
    return X.expand_queries(part_queries(t)).select("query_id", "prompt", long("prompt_no").alias("prompt_no"))


@query("label_prompts", "B7", """
    WITH l AS (SELECT p_brand || ' ' || p_type AS label, list(DISTINCT p_name ORDER BY p_name) AS prompts FROM part GROUP BY 1)
    SELECT label, unnest(list_append(prompts, 'a video of ' || prompts[1])) AS prompt FROM l""")
def _(t):
    label = F.concat_ws(" ", "p_brand", "p_type").alias("label")
    labels = t.read("part").groupBy(label).agg(F.array_sort(F.collect_set("p_name")).alias("prompts"))
    return L.label_prompts(labels)


@query("uniform_sample_indices", "B8", """
    WITH p AS (SELECT p_partkey, p_size * 7 AS n, 14 AS k FROM part)
    SELECT p_partkey, i::BIGINT AS position, floor(i * ((n - 1)::DOUBLE / 13))::BIGINT AS frame FROM p, range(0, 14) r(i)""")
def _(t):
    chosen = M.sample_indices(F.col("p_size") * 7, F.lit(14))
    rows = t.read("part").select("p_partkey", F.posexplode(chosen).alias("position", "frame"))
    return rows.select("p_partkey", long("position").alias("position"), long("frame").alias("frame"))


@query("evenly_picked_indices", "B8", """
    WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::INT AS n, l_linenumber + 3 AS k FROM lineitem),
    x AS (SELECT *, unnest(CASE WHEN k >= n THEN range(0, n) ELSE
              list_distinct(list_transform(range(0, k), lambda i: round_even(i * ((n - 1)::DOUBLE / (k - 1)), 0)::BIGINT)) END) AS frame FROM p)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, frame FROM x""")
def _(t):
    n, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") + 3
    rows = t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.explode(M.pick_evenly(n, k)).alias("frame"))
    return rows.withColumns({"l_linenumber": long("l_linenumber"), "frame": long("frame")})


@query("sampled_frame_rows", "B8", """
    SELECT video_id, frame_idx::BIGINT AS frame_idx FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
    WHERE list_contains(list_transform(range(0, 4), lambda i: floor(i * ((n - 1)::DOUBLE / 3))::BIGINT), frame_idx)""",
    "vectors frames")
def _(t):
    sizes = t.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames"))
    picked = FR.sampled_frames(t.frames.join(sizes, "video_id"), 4)
    return picked.select("video_id", long("frame_idx").alias("frame_idx"))


@query("frame_budget", "B9", """
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, greatest(4, least(14, floor(l_quantity / 8 * 2),
        CASE WHEN l_discount = 0 THEN 14 ELSE floor(l_discount * 400 / 3) + 2 END))::BIGINT AS frames FROM lineitem""")
def _(t):
    budget = M.frame_budget(F.col("l_quantity") / 8, F.col("l_discount") * 400)
    return t.read("lineitem").select("l_orderkey", "l_partkey", long("l_linenumber").alias("l_linenumber"), long(budget).alias("frames"))


@query("video_duration", "B10", """
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
           CASE WHEN l_quantity > 10 AND l_tax > 0 THEN round(l_quantity / l_tax, 6) END AS seconds FROM lineitem""")
def _(t):
    frames = F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(F.lit(0.0))
    return t.read("lineitem").select("l_orderkey", "l_partkey", long("l_linenumber").alias("l_linenumber"),
                                     F.round(M.video_duration(frames, F.col("l_tax")), 6).alias("seconds"))


_DETECTIONS = """
    SELECT l_orderkey AS video_id, l_partkey, l_suppkey, l_linenumber::BIGINT AS n, (l_quantity - 10)::INT AS x1, (l_linenumber * 5 - 12)::INT AS y1,
           (l_quantity * 2)::INT AS x2, (l_linenumber * 12)::INT AS y2, l_discount * 10 AS det_score,
           CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 4 - 100 END AS yaw, l_tax * 400 AS blur_var FROM lineitem"""


def detections(t):
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("video_id"), "l_partkey", "l_suppkey", long("l_linenumber").alias("n"),
        (F.col("l_quantity") - 10).cast("int").alias("x1"), (F.col("l_linenumber") * 5 - 12).alias("y1"),
        (F.col("l_quantity") * 2).cast("int").alias("x2"), (F.col("l_linenumber") * 12).alias("y2"),
        (F.col("l_discount") * 10).alias("det_score"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 4 - 100).alias("yaw"), (F.col("l_tax") * 400).alias("blur_var"),
    )


@query("face_quality_gate", "B13", f"""
    SELECT video_id, l_partkey, l_suppkey, n FROM ({_DETECTIONS})
    WHERE det_score >= 0.35 AND (yaw IS NULL OR abs(yaw) <= 75) AND blur_var >= 10
      AND (greatest(x2, 0) - greatest(x1, 0)) * (greatest(y2, 0) - greatest(y1, 0)) >= 576""")
def _(t):
    return I.gated_detections(detections(t)).select("video_id", "l_partkey", "l_suppkey", "n")


@query("box_area", "B14", f"""
    SELECT video_id, l_partkey, l_suppkey, n,
           ((greatest(x2, 0) - greatest(x1, 0)) * (greatest(y2, 0) - greatest(y1, 0)))::BIGINT AS area FROM ({_DETECTIONS})""")
def _(t):
    area = M.box_area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return detections(t).select("video_id", "l_partkey", "l_suppkey", "n", long(area).alias("area"))


@query("largest_faces", "D5 A4", f"""
    SELECT video_id, arg_max(l_partkey * 100000 + l_suppkey, ((x2 - x1) * (y2 - y1), -(n * 10000000 + l_partkey * 100 + l_suppkey))) AS face
    FROM ({_DETECTIONS}) GROUP BY video_id""")
def _(t):
    order = F.col("n") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    faces = detections(t).withColumns({"embedding": F.col("l_partkey") * 100000 + F.col("l_suppkey"), "det_ord": order})
    return SF.largest_faces(faces, "video_id").select("video_id", F.col("embedding").alias("face"))


@query("most_confident_faces", "D6", f"""
    SELECT video_id, arg_max(l_partkey * 100000 + l_suppkey, (det_score, -(n * 10000000 + l_partkey * 100 + l_suppkey))) AS face
    FROM ({_DETECTIONS}) GROUP BY video_id""")
def _(t):
    order = F.col("n") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    faces = detections(t).withColumns({"embedding": F.col("l_partkey") * 100000 + F.col("l_suppkey"), "det_ord": order})
    return SF.most_confident_faces(faces, "video_id").select("video_id", F.col("embedding").alias("face"))


@query("thumbnail_score", "B16", """
    SELECT id, round(coalesce(confidence, 0) - abs(coalesce(pose_yaw, 0)) / 180.0 * 0.2, 6) AS score FROM faces""", "faces")
def _(t):
    return t.faces.select("id", F.round(M.thumbnail_score(F.col("confidence"), F.col("pose_yaw")), 6).alias("score"))


@query("file_names", "B17", r"""
    SELECT page_id, replace(replace(url, '/', '\'), '\', '/') AS path, split_part(url, '/', -1) AS name,
           CASE WHEN regexp_matches(split_part(url, '/', -1), '[^.]\.[^.]*$')
                THEN regexp_extract(split_part(url, '/', -1), '^(.*[^.])\.[^.]*$', 1) ELSE split_part(url, '/', -1) END AS stem FROM pages""")
def _(t):
    path = X.slashes(F.replace(F.col("url"), F.lit("/"), F.lit("\\")))
    return t.read("pages").select("page_id", path.alias("path"), X.basename(path).alias("name"), X.stem(path).alias("stem"))


_MEDIA_NAMES = """
    SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_size < 10 THEN '.JPG' WHEN p_size < 20 THEN '.png' WHEN p_size < 30 THEN '.mp4'
           WHEN p_size < 40 THEN '.WMV' ELSE '.txt' END AS path FROM part"""


def media_names(t):
    ending = (
        F.when(F.col("p_size") < 10, ".JPG").when(F.col("p_size") < 20, ".png").when(F.col("p_size") < 30, ".mp4")
        .when(F.col("p_size") < 40, ".WMV").otherwise(".txt")
    )
    return t.read("part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ending).alias("path"))


@query("media_types", "B18", f"""
    SELECT p_partkey, regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') AS image,
           regexp_matches(lower(path), '\\.(mp4|mkv|avi|mov|webm)$') AS library_video,
           regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv|wmv)$') AS import_video FROM ({_MEDIA_NAMES})""")
def _(t):
    path = F.col("path")
    return media_names(t).select(
        "p_partkey", M.has_extension(path, M.IMAGE_EXTENSIONS).alias("image"),
        M.has_extension(path, M.LIBRARY_VIDEO_EXTENSIONS).alias("library_video"),
        M.has_extension(path, M.IMPORT_VIDEO_EXTENSIONS).alias("import_video"),
    )


@query("accepted_uploads", "A3", f"""
    SELECT p_partkey, 'test_images/' || path AS path FROM ({_MEDIA_NAMES}) WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png)$')""")
def _(t):
    uploads = media_names(t).withColumn("file_name", F.concat(F.lit("C:\\photos\\"), "path")).drop("path")
    return SF.accepted_uploads(uploads).select("p_partkey", "path")


@query("original_names", "B19", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'clip_' || o_custkey || '.jpg' END AS original FROM orders""")
def _(t):
    stamp = (F.lit(1700000000000) + F.col("o_orderkey")).cast("string")
    plain = F.concat(F.lit("clip_"), "o_custkey", F.lit(".jpg"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("clip_"), "o_custkey", F.lit("_"), stamp, F.lit(".jpg"))).otherwise(plain)
    return t.read("orders").select("o_orderkey", X.original_name(name).alias("original"))


@query("stale_signatures", "B20", """
    SELECT event_id, NOT (user_id < 50 AND event_type <> 'error') AS stale FROM events""")
def _(t):
    now = M.signature(F.unix_micros(F.col("ts").cast("timestamp")), F.length("props"))
    size = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.length("props"))
    known = F.when(F.col("user_id") < 50, M.signature(F.unix_micros(F.col("ts").cast("timestamp")), size))
    return t.read("events").select("event_id", M.is_stale(known, now).alias("stale"))


@query("media_dates", "B21", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS from_epoch,
           CASE WHEN event_type = 'error' THEN 'Recent' ELSE strftime(ts, '%Y-%m-%d') END AS from_text FROM events""")
def _(t):
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.read("events").select("event_id", X.mtime_date(F.unix_timestamp("ts")).alias("from_epoch"), X.created_date(text).alias("from_text"))


@query("date_headings", "B22", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Recent' WHEN o_orderstatus = 'O' THEN 'no date'
        ELSE strftime(o_orderdate, '%B %-d, %Y') END AS heading FROM orders""")
def _(t):
    date = F.when(F.col("o_orderstatus") == "P", "Recent").when(F.col("o_orderstatus") == "O", "no date").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return t.read("orders").select("o_orderkey", X.date_heading(date).alias("heading"))


@query("label_tags", "B23", """
    SELECT id, unnest(CASE WHEN label LIKE 'Proc%' THEN []::VARCHAR[] WHEN label = 'unknown' THEN ['unknown'] ELSE string_split(lower(label), ', ') END) AS tag
    FROM videos""", "videos")
def _(t):
    return t.videos.select("id", F.explode(X.tags(F.col("label"))).alias("tag"))


@query("default_person_names", "B24", """
    SELECT person_id, CASE WHEN name IS NULL OR name = 'Unknown' THEN 'Person ' || (substr(person_id, 8)::BIGINT + 1) ELSE name END AS photo_name,
        CASE WHEN name IS NULL THEN 'Person #' || person_id ELSE name END AS video_name,
        CASE WHEN name IS NULL OR name = 'Unknown' THEN 'some body x' ELSE name END AS odd_name FROM people""", "people")
def _(t):
    name, pid = F.col("name"), F.col("person_id")
    return t.people.select("person_id", X.photo_person_name(name, pid).alias("photo_name"), X.video_person_name(name, pid).alias("video_name"),
                           X.photo_person_name(name, F.lit("some_body_x")).alias("odd_name"))


@query("file_identities", "B25", """
    SELECT c_custkey, c_mktsegment || '_' || c_nationkey AS identity, c_mktsegment || ' ' || c_nationkey AS spoken FROM customer""")
def _(t):
    path = F.concat(F.lit("lib/"), "c_mktsegment", F.lit("_"), "c_nationkey", F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".jpg"))
    who = X.identity_of(path)
    return t.read("customer").select("c_custkey", who.alias("identity"), X.spaced(who).alias("spoken"))


_PROBES = """
    SELECT p_partkey, CASE WHEN p_size < 35 THEN 'clip.MP4' ELSE 'clip.avi' END AS path,
        CASE WHEN p_name LIKE 'red%' THEN 'hevc' WHEN p_name LIKE 'small%' THEN NULL ELSE 'h264' END AS video,
        CASE WHEN p_name LIKE 'small%' THEN NULL WHEN p_size < 10 THEN 'yuv422p' ELSE 'yuv420p' END AS pix_fmt,
        CASE WHEN p_type = 'ECONOMY' THEN NULL WHEN p_type = 'PROMO' THEN 'ac3' WHEN p_type = 'SMALL' THEN 'opus' ELSE 'aac' END AS audio FROM part"""


def probes(t):
    name, kind = F.col("p_name"), F.col("p_type")
    codec = F.when(name.startswith("red"), "hevc").otherwise("h264")
    pixels = F.when(F.col("p_size") < 10, "yuv422p").otherwise("yuv420p")
    video = F.when(
        ~name.startswith("small"),
        F.concat(F.lit("  Stream #0:0: Video: "), codec, F.lit(" (High), "), pixels, F.lit("(tv, bt709), 1280x720, 30 fps\n")),
    )
    sound = F.when(kind == "PROMO", "ac3").when(kind == "SMALL", "opus").otherwise("aac")
    audio = F.when(kind != "ECONOMY", F.concat(F.lit("  Stream #0:1: Audio: "), sound, F.lit(" (LC), 44100 Hz\n")))
    path = F.when(F.col("p_size") < 35, "clip.MP4").otherwise("clip.avi")
    text = F.concat(F.lit("Input #0, from 'clip'\n"), F.coalesce(video, F.lit("")), F.coalesce(audio, F.lit("")))
    parts = t.read("part").select("p_partkey", path.alias("path"), text.alias("probe_text"))
    info = F.col("probe_text")
    return parts.select("p_partkey", "path", M.probe_video_codec(info).alias("video"), M.probe_pixel_format(info).alias("pix_fmt"),
                        M.probe_audio_codec(info).alias("audio"))


@query("probe_fields", "B27", f"SELECT p_partkey, video, pix_fmt, audio FROM ({_PROBES})")
def _(t):
    return probes(t).drop("path")


@query("playable_videos", "B26", f"""
    SELECT p_partkey, path = 'clip.MP4' AND coalesce(video = 'h264' AND pix_fmt = 'yuv420p', false) AND coalesce(audio, '') <> 'ac3' AS playable
    FROM ({_PROBES})""")
def _(t):
    return probes(t).select("p_partkey", M.is_playable(*[F.col(c) for c in ("path", "video", "pix_fmt", "audio")]).alias("playable"))


@query("conversion_plan", "B28", f"""
    SELECT p_partkey, CASE WHEN video = 'h264' AND pix_fmt = 'yuv420p' THEN 'copy' ELSE 'encode' END AS video_action,
        CASE WHEN audio IS NULL THEN 'none' WHEN audio = 'aac' THEN 'copy' ELSE 'encode' END AS audio_action FROM ({_PROBES})""")
def _(t):
    return probes(t).select("p_partkey", M.video_action(F.col("video"), F.col("pix_fmt")).alias("video_action"),
                            M.audio_action(F.col("audio")).alias("audio_action"))


@query("prefixed_ids", "B29", """
    SELECT id, 'video_' || id AS prefixed, id::VARCHAR AS stripped, 'photo_' || id AS other FROM persons""", "persons")
def _(t):
    video, photo = X.prefixed_id("video", F.col("id")), X.prefixed_id("photo", F.col("id"))
    return t.persons.select("id", video.alias("prefixed"), X.strip_prefix("video", video).alias("stripped"), X.strip_prefix("video", photo).alias("other"))


@query("cleanup_reasons", "B15", """
    WITH t AS (SELECT DISTINCT thumbnail_path FROM faces WHERE l_tax <= 0.06)
    SELECT id, CASE WHEN confidence < 0.35 THEN 'low confidence' WHEN abs(pose_yaw) > 70 THEN 'extreme side-view angle'
        ELSE 'file missing on disk' END AS reason FROM faces LEFT JOIN t USING (thumbnail_path)
    WHERE confidence < 0.35 OR abs(pose_yaw) > 70 OR t.thumbnail_path IS NULL""", "faces")
def _(t):
    thumbs = t.faces.filter("l_tax <= 0.06").select(F.concat(F.lit("thumbs/"), "thumbnail_path").alias("path"))
    return faces_to_clean(t.faces, thumbs).select("id", "reason")
