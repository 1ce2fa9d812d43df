import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.functions import vectors as V
from reelgraph.operators import labeling as L
from reelgraph.operators import search as S
from tests import data as D


def brute(queries, rows, k):
    s = np.round(D.unit(queries) @ D.unit(rows).T, 12)
    return {q: sorted(range(len(rows)), key=lambda i: (-s[q, i], i))[:k] for q in range(len(queries))}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_knn_equals_brute_force(spark, limit, k):
    rows = D.clustered(1, 120, copies=60)  # exact copies tie: smallest id first
    queries = rows[:15]
    q = D.frame(spark, queries).withColumnRenamed("seq", "query_id")
    got = S.knn(q, D.frame(spark, rows).repartition(5), k, broadcast_bytes=limit)
    assert found(got) == brute(queries, rows, k)


def test_knn_grid_with_many_blocks(spark, monkeypatch):
    from reelgraph.operators import kernels as K

    monkeypatch.setattr(K, "rows_per_block", lambda width: 20)
    rows = D.clustered(2, 130)
    q = D.frame(spark, rows).withColumnRenamed("seq", "query_id")
    assert found(S.knn(q, D.frame(spark, rows), 7, broadcast_bytes=0)) == brute(rows, rows, 7)


def test_knn_with_nothing(spark):
    rows = D.frame(spark, np.eye(3))
    none = rows.filter("seq < 0")
    assert S.knn(none.withColumnRenamed("seq", "query_id"), rows, 3).count() == 0
    assert S.knn(rows.withColumnRenamed("seq", "query_id"), none, 3).count() == 0


def scores(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "query_id long, id long, score double")


def test_cutoff_rules(spark):
    # best 0.5: 0.44 is the relative cutoff; the first eight stay above the floor
    values = [0.5, 0.45, 0.44, 0.3, 0.29, 0.28, 0.27, 0.26, 0.25, 0.19]
    kept = [r.id for r in S.cutoff(scores(spark, values)).orderBy("rank").collect()]
    assert kept == [0, 1, 2, 3, 4, 5, 6, 7]
    assert S.cutoff(scores(spark, [0.19, 0.1])).count() == 0
    many = [0.5] * 12 + [0.2]
    assert S.cutoff(scores(spark, many)).count() == 12
    assert S.cutoff(scores(spark, many), limit=5).count() == 5


def test_single_hit_response(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    v = spark.createDataFrame([(0, [0.95, float(np.sqrt(1 - 0.95**2))])], "seq long, embedding array<float>")
    row = S.photo_search(q, v, limit=5).first()
    assert row.id == 0 and row.score == pytest.approx(0.95, abs=1e-6)


@pytest.mark.parametrize("limit", [None, 0])
def test_smooth_max_over_split_videos(spark, limit):
    rows = D.clustered(3, 100)
    video = [0 if i < 40 else i % 6 for i in range(100)]  # one video holds much of it, spread over partitions
    frames = D.frame(spark, rows, video_id=video).repartition(7)
    q = D.frame(spark, rows[:4]).withColumnRenamed("seq", "query_id")
    got = {(r.query_id, r.id): r.score for r in S.smooth_max_scores(q, frames, broadcast_bytes=limit).collect()}
    s = D.unit(rows[:4]) @ D.unit(rows).T
    for (query, v), value in got.items():
        x = s[query, [i for i in range(100) if video[i] == v]]
        assert value == pytest.approx(0.02 * np.log(np.mean(np.exp((x - x.max()) / 0.02))) + x.max(), abs=1e-9)
    assert len(got) == 4 * len(set(video))


def test_frequent_keys_are_spread_over_blocks(spark, monkeypatch):
    from reelgraph.operators import identity as I
    from reelgraph.operators import kernels as K

    monkeypatch.setattr(K, "rows_per_block", lambda width: 15)
    rows = D.clustered(8, 60, copies=30)
    person = [1 if i % 3 else i % 4 + 2 for i in range(len(rows))]
    known = D.frame(spark, rows[10:], person_id=person[10:])
    faces = D.frame(spark, rows[:10]).withColumnRenamed("seq", "id")
    small = {r.id: r.person_id for r in I.best_person(faces, known).collect()}
    grid = {r.id: r.person_id for r in I.best_person(faces, known, broadcast_bytes=0).collect()}
    s = np.round(D.unit(rows[:10]) @ D.unit(rows[10:]).T, 12)
    assert grid == small == {i: min((-s[i, j], person[10 + j]) for j in range(len(rows) - 10))[1] for i in range(10)}
    labels = spark.createDataFrame([("p", 1, [1.0] * 8)], "label string, label_ord int, embedding array<float>")
    examples = known.withColumn("corrected_label", L.F.lit("p"))
    boosts = [
        {r.item_id: round(r.boost, 9) for r in L.feedback_boosts(faces, examples, labels, broadcast_bytes=b).collect()}
        for b in (None, 0)
    ]
    assert boosts[0] == boosts[1] and boosts[0]


@pytest.mark.parametrize("limit", [None, 0])
def test_target_ranks(spark, limit):
    rows = D.clustered(4, 60, noise=1.0)
    queries = rows[::-1].copy()
    q = D.frame(spark, queries, target=list(range(60))).withColumnRenamed("seq", "query_id")
    got = {r.query_id: r["rank"] for r in S.target_ranks(q, D.frame(spark, rows), broadcast_bytes=limit).collect()}
    order = brute(queries, rows, 60)
    assert got == {i: order[i].index(i) + 1 for i in range(60)}


def test_column_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    row = df.select(
        V.l2_normalize("v").alias("n"), V.l2_normalize("z").alias("nz"), V.l2_normalize("z", eps=1e-6).alias("e"),
        V.cosine("v", "z").alias("c"), V.histogram_correlation("z", "z").alias("h"), V.softmax("v").alias("s"),
    ).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.nz == [0, 0] and row.e == [0, 0]
    assert row.c == 0 and row.h == 1.0
    assert row.s == pytest.approx([1 / (1 + np.e), np.e / (1 + np.e)])


def classify_one(vector, prototypes, feedback):
    """Sequential rule for one item."""
    sims = D.unit(prototypes) @ D.unit([vector])[0]
    for label, example in feedback:
        if np.linalg.norm(example) > 0:
            sim = np.clip(D.unit([vector])[0] @ D.unit([example])[0], 0, 1)
            if sim > 0.8:
                sims[label] += 0.05 * (sim - 0.8) / 0.2
    if sims.max() < 0.18:
        return "video"
    e = np.exp(50 * (sims - sims.max()))
    p = e / e.sum()
    order = np.argsort(-p, kind="stable")
    return ", ".join(f"L{i}" for i in order[:3] if p[i] >= 0.4 * p.max() and (p[i] >= 0.03 or i == order[0]))


def test_classify_equals_sequential_rule(spark):
    rng = np.random.default_rng(6)
    items, protos = rng.normal(size=(80, 6)).astype(np.float32), rng.normal(size=(12, 6)).astype(np.float32)
    protos[1] = protos[0] * 1.5  # near ties
    items[5] = 0
    examples = [(i % 3, items[i]) for i in range(0, 80, 4)] + [(2, np.zeros(6, np.float32))]
    label_vectors = spark.createDataFrame(
        [(f"L{i}", i, [float(x) for x in v]) for i, v in enumerate(protos)], "label string, label_ord int, embedding array<float>"
    )
    feedback = spark.createDataFrame(
        [(f"L{k}", [float(x) for x in v]) for k, v in examples] + [("gone", [1.0] * 6), ("L0", None)],
        "corrected_label string, embedding array<float>",
    )
    got = L.classify(D.frame(spark, items).withColumnRenamed("seq", "id"), label_vectors, feedback)
    assert {r.item_id: r.label for r in got.collect()} == {i: classify_one(v, protos, examples) for i, v in enumerate(items)}


def test_large_vocabulary_gives_the_same_labels(spark):
    rng = np.random.default_rng(4)
    items, protos = rng.normal(size=(40, 6)), rng.normal(size=(9, 6))
    labels = spark.createDataFrame(
        [(f"L{i}", i, [float(x) for x in v]) for i, v in enumerate(protos)], "label string, label_ord int, embedding array<float>"
    )
    feedback = spark.createDataFrame([("L3", [float(x) for x in items[0]])], "corrected_label string, embedding array<float>")
    df = D.frame(spark, items).withColumnRenamed("seq", "id")
    sent = {r.item_id: r.label for r in L.classify(df, labels, feedback).collect()}
    assert {r.item_id: r.label for r in L.classify(df, labels, feedback, vocabulary_bytes=10).collect()} == sent


def test_state_leaves_once(spark):
    from reelgraph.operators import kernels as K

    rows = D.clustered(5, 150, copies=30)
    held = D.frame(spark, rows).repartition(3)
    q = held.select(F.col("seq").alias("_q"), "embedding")
    v = D.frame(spark, rows).select(F.col("seq").alias("_id"), "embedding")
    best = K.fold_scores(
        q, v, K.BestK(6), "query_id long, id long, score double", held_keys=["_q"], passed_keys=["_id"], send="held",
        broadcast_bytes=0, part_rows=20,
    )
    n = len(rows)
    assert best.count() == 6 * n and best.select("query_id", "id").distinct().count() == 6 * n
    one = K.fold_scores(
        held.select(F.col("seq").alias("_id"), "embedding"), v.withColumnRenamed("_id", "_p"), K.BestOne("other"),
        "id long, partner long, sim double", held_keys=["_id"], passed_keys=["_p"], send="passed", broadcast_bytes=0,
        part_rows=20,
    )
    s = np.round(D.unit(rows) @ D.unit(rows).T, 12)
    np.fill_diagonal(s, -2)
    assert {r.id: r.partner for r in one.collect()} == dict(enumerate(s.argmax(axis=1)))
    assert one.count() == n


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("block", [1 << 10, 1 << 25])
def test_video_search_drops_only_what_the_cutoff_drops(spark, monkeypatch, limit, block):
    from reelgraph.operators import kernels as K

    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    monkeypatch.setattr(K, "rows_per_block", lambda width: 4)
    monkeypatch.setattr(S, "VIDEO_FRAMES", 30)
    rng = np.random.default_rng(8)
    rows = D.clustered(8, 600)
    videos = np.minimum(rng.integers(0, 90, len(rows)), 60)  # the last one has a third of all frames
    frames = D.frame(spark, rows)
    place = spark.createDataFrame([(i, int(v)) for i, v in enumerate(videos)], "seq long, video_id long")
    frames = frames.join(place, "seq").select("video_id", "embedding")
    frames = frames.unionByName(frames.limit(3).withColumn("video_id", F.lit(None).cast("long")))
    known = frames.filter("video_id is not null")
    q = D.frame(spark, rows[:12]).withColumnRenamed("seq", "query_id")

    def kept(df):
        return {(r.query_id, r.id): (r["rank"], round(r.score, 9)) for r in df.collect()}

    every = S.smooth_max_scores(q, known)
    assert kept(S.video_search(q, frames, broadcast_bytes=limit)) == kept(S.cutoff(every))
    left = S.smooth_max_scores(q, frames, broadcast_bytes=limit, at_least=S.MIN_SCORE)
    assert left.count() < every.count() == 12 * 61
    assert S.video_search(q, frames.filter("video_id < 0"), broadcast_bytes=limit).count() == 0


def test_held_rows_are_counted_as_doubles(spark, monkeypatch):
    from reelgraph.operators import kernels as K

    class Bounded(K.BestOne):
        def start(self, rows):
            assert len(rows[1]) <= 50
            return super().start(rows)

    rows = D.clustered(6, 400)
    width = len(rows[0])
    monkeypatch.setattr(K, "HELD_BYTES", 40 * (8 * width + 16))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10")
        df = D.frame(spark, rows).coalesce(1)
        found = K.fold_scores(
            df.withColumnRenamed("seq", "_id"), df.withColumnRenamed("seq", "_p"), Bounded("other"), "id long, partner long, sim double",
            held_keys=["_id"], passed_keys=["_p"], send="passed",
        ).collect()
    finally:
        spark.conf.set(name, before)
    unit = D.unit(rows)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    assert len(found) == 400 and all(abs(r.sim - s[r.id].max()) < 1e-6 for r in found)
