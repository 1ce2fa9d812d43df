"""Vector search and labelling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgraph.functions import vectors as V
from reelgraph.operators import frames as FR
from reelgraph.operators import labeling as L
from reelgraph.operators import search as S
from reelgraph.operators.pooling import pool_vectors
from reelgraph.plans.catalog import query


def r6(c):
    return F.round(c, 6) + 0.0


@query("knn_join", "C1 B2", """
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM (
        SELECT q.seq AS query_id, v.seq AS id, list_dot_product(q.u, v.u) AS score,
               row_number() OVER (PARTITION BY q.seq ORDER BY list_dot_product(q.u, v.u) DESC, v.seq) AS rank
        FROM vectors q, vectors v) WHERE rank <= 10""", "vectors")
def _(t):
    found = S.knn(t.vectors.withColumnRenamed("seq", "query_id"), t.vectors, 10)
    return found.select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("photo_search", "E1", """
    WITH scored AS (SELECT k.label::BIGINT AS query_id, seq AS id, list_dot_product(c, u) AS score FROM centroids k, vectors),
    candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
                   max(score) OVER (PARTITION BY query_id) AS best FROM scored)
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM candidates
    WHERE rank <= 40 AND score >= 0.2 AND (score >= greatest(0.2, 0.88 * best) OR rank <= 8)""",
    "vectors elements centroids")
def _(t):
    found = S.photo_search(t.label_queries, t.vectors)
    return found.select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("video_search", "E2 D18", """
    WITH s AS (SELECT label::BIGINT AS query_id, video_id, list_dot_product(c, u) AS s FROM centroids, frames),
    m AS (SELECT *, max(s) OVER (PARTITION BY query_id, video_id) AS m FROM s),
    scored AS (SELECT query_id, video_id AS id, 0.02 * ln(avg(exp((s - m) / 0.02))) + max(m) AS score
               FROM m GROUP BY query_id, video_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
               max(score) OVER (PARTITION BY query_id) AS best FROM scored)
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM ranked
    WHERE score >= 0.2 AND (score >= greatest(0.2, 0.88 * best) OR rank <= 8)""",
    "vectors elements centroids frames")
def _(t):
    found = S.video_search(t.label_queries, t.frames)
    return found.select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


#: Vectors drawn towards their centroid, so that many are nearly as good as the best and the relative rule decides.
_CLOSE = """
    near AS (SELECT v.seq, v.label, list_transform(range(1, 65), lambda i: u[i] + 0.6 * c[i]) AS w
             FROM vectors v JOIN centroids k ON k.label = v.label),
    drawn AS (SELECT seq, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM near)"""


def _drawn(t):
    center = F.col("c")
    moved = F.zip_with("embedding", center, lambda x, y: x + F.lit(0.6) * y)
    centers = t.centroids.select("label", F.col("embedding").alias("c"))
    return t.unit_vectors.join(centers, "label").select("seq", V.l2_normalize(moved).alias("embedding"))


@query("photo_search_close", "E1", f"""
    WITH {_CLOSE}, scored AS (SELECT k.label::BIGINT AS query_id, seq AS id, list_dot_product(c, u) AS score FROM centroids k, drawn),
    candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
                   max(score) OVER (PARTITION BY query_id) AS best FROM scored)
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM candidates
    WHERE rank <= 25 AND score >= 0.2 AND (score >= greatest(0.2, 0.88 * best) OR rank <= 8)""",
    "vectors elements centroids")
def _(t):
    found = S.photo_search(t.label_queries, _drawn(t), limit=25)
    return found.select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("video_search_close", "E2 D18", f"""
    WITH {_CLOSE}, s AS (SELECT label::BIGINT AS query_id, seq // 3 AS video_id, list_dot_product(c, u) AS s FROM centroids, drawn),
    m AS (SELECT *, max(s) OVER (PARTITION BY query_id, video_id) AS m FROM s),
    scored AS (SELECT query_id, video_id AS id, 0.02 * ln(avg(exp((s - m) / 0.02))) + max(m) AS score
               FROM m GROUP BY query_id, video_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
               max(score) OVER (PARTITION BY query_id) AS best FROM scored)
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM ranked
    WHERE score >= 0.2 AND (score >= greatest(0.2, 0.88 * best) OR rank <= 8)""",
    "vectors elements centroids")
def _(t):
    frames = _drawn(t).select(F.expr("seq div 3").alias("video_id"), "embedding")
    found = S.video_search(t.label_queries, frames)
    return found.select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("smooth_max_pooling", "D18 J2", """
    WITH s AS (SELECT label::BIGINT AS query_id, video_id, list_dot_product(c, u) AS s FROM centroids, frames),
    m AS (SELECT *, max(s) OVER (PARTITION BY query_id, video_id) AS m FROM s)
    SELECT query_id, video_id AS id, round(0.02 * ln(avg(exp((s - m) / 0.02))) + max(m), 6) + 0.0 AS score
    FROM m GROUP BY query_id, video_id""", "vectors elements centroids frames")
def _(t):
    return S.smooth_max_scores(t.label_queries, t.frames).select("query_id", "id", r6("score").alias("score"))


@query("vector_by_path", "C19", """
    SELECT path, seq, round(list_sum(u), 6) + 0.0 AS total FROM vectors WHERE path = 'item_42.jpg'""", "vectors")
def _(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return S.vector_by_path(t.unit_vectors, "item_42.jpg").select("path", "seq", r6(total).alias("total"))


@query("paths_with_vectors", "C19", """
    SELECT 'item_' || doc_id || '.jpg' AS path FROM documents
    WHERE 'item_' || doc_id || '.jpg' IN (SELECT path FROM vectors)""", "vectors")
def _(t):
    paths = t.read("documents").select(F.concat(F.lit("item_"), F.col("doc_id"), F.lit(".jpg")).alias("path"))
    return S.known_paths(paths, t.vectors)


@query("target_ranks", "E10", """
    SELECT q.seq AS query_id, 1 + count(*) FILTER (WHERE v.seq <> q.seq AND (
               list_dot_product(c.c, v.u) > list_dot_product(c.c, q.u)
               OR (list_dot_product(c.c, v.u) = list_dot_product(c.c, q.u) AND v.seq < q.seq))) AS rank
    FROM vectors q JOIN centroids c ON c.label = q.label, vectors v GROUP BY q.seq""", "vectors elements centroids")
def _(t):
    asked = t.vectors.select("seq", "label").join(t.centroids, "label")
    return S.target_ranks(asked.select(F.col("seq").alias("query_id"), F.col("seq").alias("target"), "embedding"), t.vectors)


@query("l2_normalised", "B1 A5", """
    SELECT seq, round(u[1], 6) + 0.0 AS first, round(list_dot_product(u, u), 6) AS squared, len(u)::BIGINT AS width
    FROM vectors""", "vectors")
def _(t):
    u = t.unit_vectors
    return u.select("seq", r6(F.element_at("embedding", 1)).alias("first"),
                    F.round(V.squared_norm("embedding"), 6).alias("squared"), F.size("embedding").cast("long").alias("width"))


@query("normalised_with_eps", "B1", """
    SELECT vec_id AS seq, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / (
        sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-6))), 6) + 0.0 AS total FROM embeddings""")
def _(t):
    scaled = V.l2_normalize("embedding", eps=1e-6)
    return t.vectors.select("seq", r6(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("cosine_to_centroid", "B2 J2", """
    SELECT seq, round(list_dot_product(u, c), 6) + 0.0 AS sim FROM vectors JOIN centroids USING (label)""",
    "vectors elements centroids")
def _(t):
    joined = t.vectors.join(t.centroids.withColumnRenamed("embedding", "c"), "label")
    return joined.select("seq", r6(V.cosine("embedding", "c")).alias("sim"))


@query("sql_vector_functions", "J2", """
    SELECT seq, round(list_sum(u), 6) + 0.0 AS total, round(list_dot_product(u, c), 6) + 0.0 AS sim,
           round(exp(u[1] - list_max(u)) / list_sum(list_transform(u, lambda x: exp(x - list_max(u)))), 6) AS share,
           round(0.02 * ln(list_sum(list_transform(u, lambda x: exp((x - list_max(u)) / 0.02))) / len(u)) + list_max(u), 6)
               + 0.0 AS pooled
    FROM vectors JOIN centroids USING (label)""", "vectors elements centroids")
def _(t):
    V.register_sql_functions(t.spark)
    joined = t.vectors.join(t.centroids.withColumnRenamed("embedding", "c"), "label")
    unit = joined.selectExpr("seq", "l2_normalize(cast(embedding as array<double>)) AS u", "c")
    return unit.selectExpr(
        "seq", "round(aggregate(u, 0D, (a, x) -> a + x), 6) + 0D AS total", "round(cosine(u, c), 6) + 0D AS sim",
        "round(softmax(u)[0], 6) AS share", "round(smooth_max(u), 6) + 0D AS pooled",
    )


@query("mean_vectors", "D2 B5", """
    SELECT label::BIGINT AS label, unnest(list_transform(c, lambda x: round(x, 6) + 0.0)) AS x,
           generate_subscripts(c, 1)::BIGINT AS pos FROM centroids""", "vectors elements centroids")
def _(t):
    rows = t.centroids.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("label", (F.col("p") + 1).cast("long").alias("pos"), r6("v").alias("x"))


@query("video_vectors", "D2", """
    WITH m AS (SELECT video_id, pos, avg(x) AS x FROM (SELECT video_id, unnest(u) AS x, generate_subscripts(u, 1) AS pos
               FROM frames) GROUP BY video_id, pos),
    v AS (SELECT video_id, list(x ORDER BY pos) AS m FROM m GROUP BY video_id)
    SELECT video_id, round(list_max(m) / sqrt(list_dot_product(m, m)), 6) + 0.0 AS top,
           round(list_sum(m) / sqrt(list_dot_product(m, m)), 6) + 0.0 AS total FROM v""", "vectors frames")
def _(t):
    pooled = pool_vectors(t.frames, ["video_id"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return pooled.select("video_id", r6(F.array_max("embedding")).alias("top"), r6(total).alias("total"))


@query("two_prompt_vectors", "B6", """
    WITH s AS (SELECT seq, list_transform(list_zip(u, c), lambda z: z[1] + z[2]) AS s FROM vectors JOIN centroids USING (label))
    SELECT seq, round(list_sum(s) / (sqrt(list_dot_product(s, s)) + 1e-9), 6) + 0.0 AS total FROM s""",
    "vectors elements centroids")
def _(t):
    joined = t.unit_vectors.join(t.centroids.withColumnRenamed("embedding", "c"), "label")
    both = joined.select("seq", V.two_prompt_vector("embedding", "c").alias("v"))
    return both.select("seq", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("label_softmax", "B11 C3", """
    WITH s AS (SELECT seq AS item_id, c.label::BIGINT AS label_ord, list_dot_product(u, c.c) AS sim
               FROM vectors, centroids c),
    e AS (SELECT *, exp(50 * (sim - max(sim) OVER (PARTITION BY item_id))) AS e FROM s)
    SELECT item_id, label_ord, round(sim, 6) + 0.0 AS sim, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS prob FROM e""",
    "vectors elements centroids")
def _(t):
    scores = L.label_similarities(t.vectors.withColumnRenamed("seq", "id"), t.label_vectors)
    # The vocabulary bounds the rows of an item.
    lists = scores.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("label_ord", "sim"))).alias("s"))
    probs = lists.withColumn("p", V.softmax(F.col("s.sim"), L.LOGIT_SCALE))
    rows = probs.select("item_id", F.explode(F.arrays_zip("s", "p")).alias("z"))
    return rows.select("item_id", F.col("z.s.label_ord").alias("label_ord"), r6("z.s.sim").alias("sim"),
                       F.round("z.p", 6).alias("prob"))


@query("exemplar_boost", "B12", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey,
           round(CASE WHEN s > 0.8 THEN 0.05 * (s - 0.8) / 0.2 ELSE 0 END, 6) AS boost
    FROM (SELECT *, least(greatest(l_quantity / 40.0 - 0.1, 0), 1) AS s FROM lineitem)""")
def _(t):
    boost = L.exemplar_boost(F.col("l_quantity") / 40.0 - 0.1)
    return t.read("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
                                     F.round(boost, 6).alias("boost"))


_FEEDBACK = """
    WITH feedback AS (SELECT v.seq AS video_id, v.label AS label_ord, v.u FROM (
                      SELECT DISTINCT event_id % 50 AS seq FROM events WHERE event_type = 'error'
                      UNION ALL SELECT DISTINCT 50 + event_id % 50 FROM events WHERE event_type <> 'error') e JOIN vectors v USING (seq)),
    boosts AS (SELECT v.seq AS item_id, f.label_ord, sum(0.05 * (list_dot_product(v.u, f.u) - 0.3) / 0.7) AS boost
               FROM vectors v, feedback f WHERE list_dot_product(v.u, f.u) > 0.3 GROUP BY v.seq, f.label_ord)"""


def _feedback(t):
    # Every event points at one of a hundred examples.
    shift = F.when(F.col("event_type") == "error", 0).otherwise(50)
    wrong = t.read("events").select((F.col("event_id") % 50 + shift).alias("seq")).distinct()
    return t.vectors.join(wrong, "seq").select(
        F.concat(F.lit("label "), F.col("label")).alias("corrected_label"), "embedding"
    )


@query("feedback_boosts", "C4 H4", _FEEDBACK + """
    SELECT item_id, label_ord::BIGINT AS label_ord, round(boost, 6) AS boost FROM boosts""", "vectors")
def _(t):
    items = t.vectors.withColumnRenamed("seq", "id")
    found = L.feedback_boosts(items, _feedback(t), t.label_vectors, floor=0.30)
    return found.select("item_id", "label_ord", F.round("boost", 6).alias("boost"))


@query("label_selection", "E3", _FEEDBACK + """,
    sims AS (SELECT v.seq AS item_id, c.label AS label_ord, list_dot_product(v.u, c.c) + coalesce(b.boost, 0) AS sim
             FROM vectors v CROSS JOIN centroids c LEFT JOIN boosts b ON b.item_id = v.seq AND b.label_ord = c.label),
    e AS (SELECT *, max(sim) OVER (PARTITION BY item_id) AS best,
                 exp(50 * (sim - max(sim) OVER (PARTITION BY item_id))) AS e FROM sims),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY item_id) AS p,
                 row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, label_ord) AS rank FROM e),
    q AS (SELECT *, max(p) OVER (PARTITION BY item_id) AS pmax FROM p)
    SELECT item_id, CASE WHEN max(best) < 0.18 THEN 'video'
               ELSE string_agg('label ' || label_ord, ', ' ORDER BY rank) END AS label
    FROM q WHERE rank <= 3 AND p >= 0.4 * pmax AND (p >= 0.03 OR rank = 1) GROUP BY item_id""",
    "vectors elements centroids")
def _(t):
    items = t.vectors.withColumnRenamed("seq", "id")
    return L.classify(items, t.label_vectors, _feedback(t), boost_floor=0.30)


#: Half precision by hand: ten bits after the leading one, at least 2^-24 apart.
_HALF = """
    e AS (SELECT video_id, frame_idx::BIGINT AS frame_idx, unnest(u) AS x, generate_subscripts(u, 1)::BIGINT - 1 AS pos FROM frames),
    half AS (SELECT video_id, frame_idx, pos, CASE WHEN x = 0 THEN 0.0 ELSE
             round(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10)) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS x FROM e)"""


@query("frame_fallback", "A10", f"""
    WITH {_HALF}, v AS (SELECT video_id, bool_or(frame_idx = 13) AS complete FROM frames GROUP BY video_id),
    mean AS (SELECT video_id, 0::BIGINT AS frame_idx, pos, avg(x) AS x FROM e GROUP BY video_id, pos),
    unit AS (SELECT video_id, frame_idx, pos, (x / sqrt(sum(x * x) OVER (PARTITION BY video_id)))::FLOAT::DOUBLE AS x FROM mean),
    rows AS (SELECT h.* FROM half h JOIN v USING (video_id) WHERE complete
             UNION ALL SELECT u.* FROM unit u JOIN v USING (video_id) WHERE NOT complete)
    SELECT video_id, frame_idx, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY video_id, frame_idx)) + 1e-9), 5) + 0.0 AS x
    FROM rows""", "vectors frames")
def _(t):
    # Videos with all 14 frames store them packed; the others only have their mean vector.
    full = t.frames.groupBy("video_id").agg(F.bool_or(F.col("frame_idx") == 13).alias("complete"))
    packed = FR.pack_video_frames(t.frames).join(full, "video_id")
    means = pool_vectors(t.frames, ["video_id"])
    videos = packed.join(means, "video_id").select(
        F.col("video_id").alias("id"), F.when(F.col("complete"), F.col("frames")).alias("frames"), "embedding"
    )
    rows = FR.frame_rows(videos, 64).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.posexplode("embedding").alias("p", "x"))
    return rows.select("video_id", "frame_idx", F.col("p").cast("long").alias("pos"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


@query("half_precision_frames", "A9", f"""
    WITH {_HALF} SELECT video_id, frame_idx, pos, x + 0.0 AS x FROM half""", "vectors frames")
def _(t):
    packed = FR.pack_video_frames(t.frames)
    rows = packed.select("video_id", F.posexplode(FR.unpack_frames("frames", 64)).alias("frame_idx", "v"))
    cells = rows.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.posexplode("v").alias("p", "x"))
    return cells.select("video_id", "frame_idx", F.col("p").cast("long").alias("pos"), (F.col("x").cast("double") + 0.0).alias("x"))


@query("json_vectors", "A8", """
    SELECT vec_id AS seq, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""")
def _(t):
    text = t.vectors.select("seq", FR.vector_to_json("embedding").alias("text"))
    back = text.select("seq", V.as_double(FR.vector_from_json("text")).alias("v"))
    return back.select("seq", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("histogram_correlation", "B30", """
    WITH p AS (SELECT a.seq, a.u AS x, b.u AS y FROM vectors a JOIN vectors b ON b.seq = a.seq + 1)
    SELECT seq, round((list_dot_product(x, y) - list_sum(x) * list_sum(y) / len(x)) / sqrt(
        (list_dot_product(x, x) - list_sum(x) ** 2 / len(x)) * (list_dot_product(y, y) - list_sum(y) ** 2 / len(y))), 6)
        + 0.0 AS corr FROM p""", "vectors")
def _(t):
    following = t.unit_vectors.select((F.col("seq") - 1).alias("seq"), F.col("embedding").alias("next"))
    both = t.unit_vectors.join(following, "seq")
    return both.select("seq", r6(V.histogram_correlation("embedding", "next")).alias("corr"))


_HISTS = """
    WITH cells AS (SELECT video_id, frame_idx, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM frames),
    sums AS (SELECT video_id, frame_idx, pos, sum(x) OVER (PARTITION BY video_id, pos ORDER BY frame_idx) AS x FROM cells),
    hists AS (SELECT video_id, frame_idx::BIGINT AS i, list(x ORDER BY pos) AS h FROM sums GROUP BY ALL),
    corr AS (SELECT a.video_id, a.i, b.i AS j,
        (list_dot_product(a.h, b.h) - list_sum(a.h) * list_sum(b.h) / 64) / sqrt(
            (list_dot_product(a.h, a.h) - list_sum(a.h) ** 2 / 64) * (list_dot_product(b.h, b.h) - list_sum(b.h) ** 2 / 64)) AS c
        FROM hists a JOIN hists b ON a.video_id = b.video_id),
    size AS (SELECT video_id, count(*) AS n FROM hists GROUP BY video_id)"""


@query("keyframes", "E13", _HISTS.replace("FROM frames", "FROM long_frames") + """,
    scan AS (SELECT video_id, 0::BIGINT AS i, 0::BIGINT AS last, true AS keep FROM size
        UNION ALL /* step */
        SELECT s.video_id, s.i + 30, CASE WHEN c.c < 0.95 THEN s.i + 30 ELSE s.last END, c.c < 0.95
        FROM scan s JOIN corr c ON c.video_id = s.video_id AND c.i = s.i + 30 AND c.j = s.last),
    kept AS (SELECT video_id, i FROM scan WHERE keep AND video_id IN (SELECT video_id FROM size WHERE n > 4)
             UNION ALL SELECT video_id, i FROM hists WHERE video_id IN (SELECT video_id FROM size WHERE n <= 4)),
    have AS (SELECT video_id, count(*) AS k FROM kept GROUP BY video_id),
    spare AS (SELECT c.video_id, c.i, row_number() OVER (PARTITION BY c.video_id ORDER BY min(c.c), c.i) AS r
              FROM corr c JOIN kept k ON k.video_id = c.video_id AND k.i = c.j
              WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.video_id = c.video_id AND x.i = c.i) GROUP BY c.video_id, c.i)
    SELECT video_id, i AS frame_idx FROM kept
    UNION ALL SELECT s.video_id, s.i FROM spare s JOIN have h USING (video_id) WHERE r <= 4 - k""", "vectors long_frames")
def _(t):
    cells = t.long_frames.select("video_id", "frame_idx", F.posexplode("embedding").alias("pos", "x"))
    run = Window.partitionBy("video_id", "pos").orderBy("frame_idx")
    sums = cells.withColumn("x", F.sum("x").over(run))
    hists = sums.groupBy("video_id", "frame_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("hist")
    )
    return FR.keyframes(hists).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"))
