"""Similarity pairs, connected components, greedy leaders, merged clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.operators import clustering as C
from reelgraph.plans.catalog import query

PAIR_SQL = """
    pairs AS (SELECT a.seq AS src, b.seq AS dst, a.label AS la, b.label AS lb, list_dot_product(a.u, b.u) AS sim
              FROM vectors a JOIN vectors b ON a.seq < b.seq)"""

# Component of a node = smallest id that reaches it.
COMPONENT_SQL = PAIR_SQL + """,
    links AS (SELECT src AS a, dst AS b FROM pairs WHERE sim >= 0.40 UNION ALL SELECT dst, src FROM pairs WHERE sim >= 0.40),
    reach AS (SELECT seq AS node, seq AS root FROM vectors UNION /* step */ SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
    components AS (SELECT node AS seq, min(root) AS component FROM reach GROUP BY node)"""

# Leaders are found by walking the ids in order and carrying the leaders so far.
LEADER_SQL = PAIR_SQL + """,
    near AS (SELECT v.seq, coalesce(list(p.src) FILTER (p.src IS NOT NULL), []) AS ahead
             FROM vectors v LEFT JOIN pairs p ON p.dst = v.seq AND p.sim >= 0.35 GROUP BY v.seq),
    walk AS (SELECT 0::BIGINT AS i, [0::BIGINT] AS leaders
        UNION ALL /* step */
        SELECT w.i + 1, CASE WHEN list_has_any(w.leaders, n.ahead) THEN w.leaders ELSE list_append(w.leaders, w.i + 1) END
        FROM walk w JOIN near n ON n.seq = w.i + 1),
    leaders AS (SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT max(i) FROM walk)),
    joined AS (SELECT p.dst AS seq, p.src AS leader, row_number() OVER (PARTITION BY p.dst ORDER BY p.sim DESC, p.src) AS r
               FROM pairs p WHERE p.src IN (FROM leaders) AND p.dst NOT IN (FROM leaders)),
    clusters AS (SELECT seq, leader FROM joined WHERE r = 1 UNION ALL SELECT leader, leader FROM leaders)"""


def linkage_sql(table: str, threshold: float) -> str:
    """Average linkage by hand: each step merges the best pair of clusters. ``merged`` is (seq, label), the least member."""
    return f"""
    duos AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b, list_dot_product(a.u, b.u) AS s FROM {table} a JOIN {table} b ON a.seq < b.seq),
    merges AS (SELECT 0 AS step, seq, seq AS label FROM {table}
        UNION ALL /* step */
        SELECT w.step + 1, w.seq, CASE WHEN w.label = m.hi THEN m.lo ELSE w.label END FROM merges w, (
            SELECT least(x.label, y.label) AS lo, greatest(x.label, y.label) AS hi
            FROM duos p JOIN merges x ON x.seq = p.a JOIN merges y ON y.seq = p.b WHERE x.label <> y.label
            GROUP BY 1, 2 HAVING avg(p.s) > {threshold} ORDER BY avg(p.s) DESC, 1, 2 LIMIT 1) m),
    merged AS (SELECT seq, label FROM merges WHERE step = (SELECT max(step) FROM merges))"""


def two_stage_sql(threshold: float, merge: float) -> str:
    """Leaders, the linkage of their centroids, labels in the order of the least member, sizes (n)."""
    return LEADER_SQL.replace("0.35", str(threshold)) + """,
    parts AS (SELECT leader, pos, sum(x) AS x FROM clusters JOIN elements USING (seq) GROUP BY leader, pos),
    means AS (SELECT leader AS seq, list(x ORDER BY pos) AS m FROM parts GROUP BY leader),
    centers AS (SELECT seq, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS u FROM means),""" + linkage_sql("centers", merge) + """,
    grouped AS (SELECT c.seq, m.label AS cluster FROM clusters c JOIN merged m ON m.seq = c.leader),
    labelled AS (SELECT seq, dense_rank() OVER (ORDER BY cluster) - 1 AS label, count(*) OVER (PARTITION BY cluster) AS n FROM grouped)"""


TWO_STAGE_SQL = two_stage_sql(0.35, 0.30)


@query("similar_pairs", "C2", f"""
    WITH {PAIR_SQL} SELECT src, dst, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.35""", "vectors")
def _(t):
    pairs = C.similar_pairs(t.vectors, 0.35)
    return pairs.select("src", "dst", F.round("sim", 6).alias("sim"))


@query("connected_components", "F1", f"WITH {COMPONENT_SQL} SELECT seq, component FROM components", "vectors")
def _(t):
    return C.similarity_components(t.vectors, 0.40)


@query("leader_clusters", "F2", f"WITH {LEADER_SQL} SELECT seq, leader FROM clusters", "vectors")
def _(t):
    return C.greedy_leader_clusters(t.vectors, 0.35)


@query("merged_clusters", "F3", f"WITH {linkage_sql('vectors', 0.40)} SELECT seq, label AS merged FROM merged", "vectors")
def _(t):
    return C.average_linkage(t.unit_vectors, 0.40, id_col="seq")


@query("two_stage_clusters", "F4 D2", f"""
    WITH {TWO_STAGE_SQL} SELECT seq, CASE WHEN n >= 2 THEN label ELSE -1 END::BIGINT AS label FROM labelled""", "vectors elements")
def _(t):
    return C.two_stage_clusters(t.vectors, threshold=0.35, merge_threshold=0.30, min_cluster_size=2)


_LENGTH_GROUPS = "SELECT doc_id AS seq, n_chars // 50 AS label FROM documents"


def _length_groups(t):
    return t.read("documents").select(F.col("doc_id").alias("seq"), F.expr("n_chars div 50").alias("label"))


@query("small_clusters_marked", "D1", f"""
    SELECT seq, CASE WHEN count(*) OVER (PARTITION BY label) >= 3 THEN label ELSE -1 END AS label FROM ({_LENGTH_GROUPS})""")
def _(t):
    return C.mark_small_clusters(_length_groups(t), 3)


@query("cluster_count", "D28", f"""
    SELECT count(*) AS clusters FROM (SELECT label FROM ({_LENGTH_GROUPS}) GROUP BY label HAVING count(*) >= 3)""")
def _(t):
    return C.cluster_count(C.mark_small_clusters(_length_groups(t), 3))


_SWEEP = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, clusters FROM (WITH RECURSIVE {two_stage_sql(t, 0.40)}"
    " SELECT count(DISTINCT label)::BIGINT AS clusters FROM labelled)"
    for t in (0.3, 0.35, 0.4)
)


@query("threshold_sweep", "C23", _SWEEP, "vectors elements")
def _(t):
    return C.threshold_sweep(t.vectors, [0.30, 0.35, 0.40])
