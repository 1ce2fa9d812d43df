import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.functions import text as X
from reelgraph.operators import evaluation as E
from reelgraph.operators import identity as I
from reelgraph.operators import library as L
from reelgraph.operators import progress as P
from reelgraph.operators import ranking as R
from reelgraph.operators import registry as G
from tests import data as D


def test_global_positions_and_totals(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(6)
    got = R.with_row_number(df, F.col("k").desc(), name="rn").collect()
    assert {r.k: r.rn for r in got} == {k: 1000 - k for k in range(1000)}
    totals = {r.k: r.s for r in R.with_running_totals(df, [F.col("k")], {"s": "v"}).collect()}
    value = {r.k: r.v for r in df.collect()}
    assert [totals[k] for k in range(1000)] == np.cumsum([value[k] for k in range(1000)]).tolist()


def roc_brute(scores):
    pos = [s for s, g in scores if g]
    neg = [s for s, g in scores if not g]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    best = min((abs(np.mean([p < t for p in pos]) - np.mean([n >= t for n in neg])), -t) for t in {s for s, _ in scores})
    t = -best[1]
    return auc, (np.mean([p < t for p in pos]) + np.mean([n >= t for n in neg])) / 2, t


def test_roc_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    scores = [(round(float(x), 2), int(g)) for g, m in ((1, 0.4), (0, 0.1)) for x in rng.normal(m, 0.2, 120)]
    df = spark.createDataFrame(scores, "score double, genuine int").withColumn("n", F.lit(1))
    row = E.roc_summary(df).first()
    assert [row.auc, row.eer, row.eer_threshold] == pytest.approx(roc_brute(scores), abs=1e-12)


def test_genuine_scores_split_a_hot_identity(spark):
    rows = D.clustered(7, 60)
    who = ["a"] * 40 + ["b"] * 15 + [f"c{i}" for i in range(5)]
    got = {r.score: r.n for r in E.genuine_scores(D.frame(spark, rows, identity=who), block_rows=9).collect()}
    u = D.unit(rows)
    want: dict = {}
    for i in range(60):
        for j in range(i + 1, 60):
            if who[i] == who[j]:
                s = float(np.round(u[i] @ u[j], 12))
                want[s] = want.get(s, 0) + 1
    assert sum(got.values()) == sum(want.values()) == 40 * 39 // 2 + 15 * 14 // 2
    assert sorted(got) == pytest.approx(sorted(want), abs=2e-12)
    exact = np.array([s for s, n in want.items() for _ in range(n)])
    row = E.verification_summary(D.frame(spark, rows, identity=who), 0.32, block_rows=9).first()
    assert row.genuine_pairs == len(exact)
    assert [row.genuine_mean, row.genuine_std, row.frr] == pytest.approx([exact.mean(), exact.std(), 100 * (exact < 0.32).mean()])


def ami_brute(truth, pred):
    n = len(truth)
    a = [truth.count(x) for x in sorted(set(truth))]
    b = [pred.count(x) for x in sorted(set(pred))]
    cells = {(x, y): sum(t == x and p == y for t, p in zip(truth, pred, strict=True)) for x in set(truth) for y in set(pred)}
    mi = sum(c / n * math.log(n * c / (truth.count(x) * pred.count(y))) for (x, y), c in cells.items() if c)
    ha, hb = (-sum(m / n * math.log(m / n) for m in margin) for margin in (a, b))
    emi = sum(
        k / n * math.log(n * k / (x * y)) * math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x)
        for x in a for y in b for k in range(max(1, x + y - n), min(x, y) + 1)
    )
    return (mi - emi) / ((ha + hb) / 2 - emi)


def test_cluster_metrics(spark):
    rng = np.random.default_rng(3)
    truth = [int(x) for x in rng.integers(0, 4, 70)]
    pred = [t if rng.random() < 0.7 else int(rng.integers(0, 5)) for t in truth]
    table = E.contingency(spark.createDataFrame(list(zip(truth, pred, strict=True)), "truth int, pred int"))
    assert E.adjusted_mutual_info(table, chunk=3).first()[0] == pytest.approx(ami_brute(truth, pred), abs=1e-9)
    same = E.contingency(spark.createDataFrame([(t, t + 10) for t in truth], "truth int, pred int"))
    assert E.adjusted_rand(same).first()[0] == 1 and E.purity(same).first()[0] == 100
    assert tuple(E.v_measure(same).first()) == pytest.approx((1, 1, 1))
    assert tuple(E.pairwise_scores(same).first()) == (1, 1, 1)
    assert E.adjusted_mutual_info(same).first()[0] == pytest.approx(1)


def test_log_factorial(spark):
    values = [0, 1, 2, 5, 20, 170, 10_000]
    df = spark.createDataFrame([(float(v),) for v in values], "n double")
    for r in df.select("n", E.log_factorial(F.col("n")).alias("f")).collect():
        assert r.f == pytest.approx(math.lgamma(r.n + 1), abs=1e-9, rel=1e-12)


def test_throughput_fixture(spark):
    rows = [("a", i, 45, 10.0) for i in range(12)] + [("b", 0, 27, 10.0), ("b", 1, 45, 10.0)]
    seen = P.throughput_average(spark.createDataFrame(rows, "job string, seq long, items long, seconds double"))
    got = {r.job: r.rate for r in P.images_per_second(seen, default=2.7).collect()}
    assert got["a"] == pytest.approx(4.5) and got["b"] == 2.7


def test_folded_averages_equal_one_pass(spark):
    schema = "job string, seq long, items long, seconds double"
    rows = [("a" if i % 3 else "b", i, i % 4, 2.0 + i % 5) for i in range(40)] + [("c", 40, 2, 1.0)]
    whole = P.throughput_average(spark.createDataFrame(rows, schema))
    state = P.throughput_average(spark.createDataFrame(rows[:13], schema))
    for part in (rows[13:14], rows[14:30], rows[30:]):
        state = P.fold_averages(state, spark.createDataFrame(part, schema))
    want = {r.job: (r.rate, r.n) for r in whole.collect()}
    got = {r.job: (r.rate, r.n) for r in state.collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_pages_by_position(spark):
    df = spark.range(200).select(((F.col("id") * 17) % 200).alias("id"), F.lit("x").alias("wide"))
    assert [r.id for r in L.page(df, 30, 7, "id").collect()] == list(range(30, 37))
    assert [r.id for r in L.page(df, 198, 7, "id").collect()] == [198, 199] and L.page(df, 500, 7, "id").count() == 0
    assert L.nth_by_id(df, 5).first().id == 5


def keyframes_brute(hists):
    def corr(a, b):
        n = len(a)
        sa, sb = a @ a - a.sum() ** 2 / n, b @ b - b.sum() ** 2 / n
        return 1.0 if sa <= 0 or sb <= 0 else (a @ b - a.sum() * b.sum() / n) / math.sqrt(sa * sb)

    kept = [0]
    for i in range(1, len(hists)):
        if corr(hists[i], hists[kept[-1]]) < 0.95:
            kept.append(i)
    rest = [i for i in range(len(hists)) if i not in kept]
    rest.sort(key=lambda i: (min(corr(hists[i], hists[k]) for k in kept), i))
    return sorted(kept + rest[: max(0, 4 - len(kept))])


def test_keyframes_of_any_length_and_numbering(spark):
    from reelgraph.operators.frames import keyframes

    rng = np.random.default_rng(3)
    videos = {1: 300, 2: 20, 3: 3, 4: 1, 5: 40}
    hists = {v: np.cumsum(rng.random((n, 16)), axis=0) for v, n in videos.items()}
    hists[1] = np.array([[float((i * i + j * 7) % 11) for j in range(16)] for i in range(300)])
    hists[5] = np.ones((40, 16))
    rows = [(v, 30 * i + v, h[i].tolist()) for v, h in hists.items() for i in range(len(h))]
    got = {}
    for r in keyframes(spark.createDataFrame(rows, "video_id long, frame_idx int, hist array<double>").repartition(5)).collect():
        got.setdefault(r.video_id, []).append((r.frame_idx - r.video_id) // 30)
    assert {v: sorted(x) for v, x in got.items()} == {v: keyframes_brute(h) for v, h in hists.items()}
    assert len(got[1]) > 14 and len(got[5]) == 4 and len(got[3]) == 3


def test_repeated_keys_count_once(spark):
    videos = spark.createDataFrame([(1, "uploaded_videos/a.mp4", "cat", [1.0], None)], "id long, path string, label string, embedding array<double>, frames binary")
    files = spark.createDataFrame([("moved/a.mp4",), ("uploaded_videos/a.mp4",), ("x/b.mp4",), ("w/b.mp4",)], "path string")
    thumbs = spark.createDataFrame([("t/a.jpg",)], "path string")
    actions = {(r.file_name, r.action, r.new_path) for r in G.reconcile_videos(videos, files, thumbs).collect()}
    assert actions == {("a.mp4", "keep", "uploaded_videos/a.mp4"), ("b.mp4", "add", "w/b.mp4")}
    feedback = spark.createDataFrame([], "video_id long, corrected_label string, embedding array<double>, created_at timestamp")
    corrections = spark.createDataFrame([(1, "dog", "2024-01-01 00:00:00"), (1, "bird", "2024-01-02 00:00:00")], "video_id long, corrected_label string, t string")
    corrections = corrections.select("video_id", "corrected_label", F.to_timestamp("t").alias("created_at"))
    changed, learned = G.correct_labels(videos, feedback, corrections)
    assert [r.label for r in changed.collect()] == ["bird"] and learned.count() == 2
    new = spark.createDataFrame([(1, "x", [2.0], None), (1, "y", [1.0], None)], "id long, label string, embedding array<double>, frames binary")
    assert [r.label for r in G.update_vectors(videos, new).collect()] == ["y"]
    moves = spark.createDataFrame([("q/a.mp4", "m/1.mp4"), ("r/a.mp4", "m/2.mp4")], "old_path string, new_path string")
    assert [r.path for r in G.repoint(videos, moves).collect()] == ["m/2.mp4"]
    meta = spark.createDataFrame([("k", "1"), ("k", "2")], "key string, value string")
    assert [tuple(r) for r in G.set_meta(meta.limit(0), meta).collect()] == [("k", "2")]


def test_unmatched_positions_raise(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "seq long, embedding array<double>")
    paths = spark.createDataFrame([(0, "a"), (5, "b")], "seq long, path string")
    with pytest.raises(ValueError):
        G.zip_by_position(vectors, paths)


def test_any_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\nCat\t",), ("\n\u00a0",), ("\u3000two words \x1f",)], "text string")
    assert [r.text for r in X.clean_queries(df).collect()] == ["cat", "two words"]
    tags = spark.createDataFrame([("A,\tB\n, ,c",)], "l string").select(X.tags(F.col("l")).alias("t")).first().t
    assert tags == ["a", "b", "c"]


def test_sql_functions_handle_zero_vectors_and_scale(spark):
    from reelgraph.functions.vectors import register_sql_functions

    register_sql_functions(spark)
    row = spark.sql("""select cosine(array(0D, 0D), array(1D, 0D)) as z, cosine(null, array(1D)) as n, softmax(array(1D, 2D)) as s,
        softmax(array(1D, 2D), 50D) as t, smooth_max(array(0.1D, 0.2D)) as m, smooth_max(array(0.1D, 0.2D), 1D) as w""").first()
    assert row.z == 0.0 and row.n is None
    assert row.s == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and row.t[1] == pytest.approx(1)
    assert row.m == pytest.approx(0.02 * math.log((1 + math.exp(-5)) / 2) + 0.2)
    assert row.w == pytest.approx(math.log((math.exp(0.1) + math.exp(0.2)) / 2))


def test_registry_settings_and_errors(spark):
    meta = spark.createDataFrame([("a", "1")], "key string, value string")
    vectors = spark.createDataFrame([("p", 0)], "path string, seq long")
    assert G.get_meta(meta, "a") == "1" and G.get_meta(meta, "b", "x") == "x"
    assert {tuple(r) for r in G.set_meta(meta, spark.createDataFrame([("a", "2"), ("c", "3")], meta.schema)).collect()} == {("a", "2"), ("c", "3")}
    assert G.stored_model(meta, vectors, "new") == G.LEGACY_MODEL_ID
    assert G.stored_model(meta, vectors.limit(0), "new") == "new"
    with pytest.raises(ValueError):
        G.zip_by_position(vectors, vectors.limit(0))
    assert G.emptied(vectors)[0].count() == 0 and G.emptied(vectors)[0].schema == vectors.schema


def test_text_columns(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(X.stem(F.lit("a/b.c.mp4"))) == "b.c" and one(X.stem(F.lit("a/.hidden"))) == ".hidden"
    assert one(X.original_name(F.lit("tree_20260101120000.jpg"))) == "tree.jpg" and one(X.original_name(F.lit("name_12.jpg"))) is None
    assert one(X.date_heading(F.lit("2026-06-04"))) == "June 4, 2026" and one(X.date_heading(F.lit("Recent"))) == "Recent"
    assert one(X.mtime_date(F.lit(0))) is None and one(X.created_date(F.lit(None).cast("string"))) == "Recent"
    assert one(X.identity_of(F.lit("x/First_Last_0001.jpg"))) == "First_Last"
    assert one(X.prompt_templates(F.lit("  "))) == []
    assert one(X.prompt_templates(F.lit("a photo of x"))) == ["a photo of x"]
    assert len(one(X.prompt_templates(F.lit("apple")))) == 7 and "a photo of an apple" in one(X.prompt_templates(F.lit("apple")))
    assert len(one(X.prompt_templates(F.lit("red car")))) == 6 and len(one(X.prompt_templates(F.lit("Red car")))) == 5
    assert one(X.tags(F.lit("Hammer Throw, , Processing AI tags..."))) == ["hammer throw"]


def test_library_edges(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, seq long")
    assert [r.id for r in L.select_range(items, "c", "b").orderBy("seq").collect()] == ["b", "c"]
    assert L.select_range(items, "c", "zz").count() == 0
    assert [r.id for r in L.select_range(items, "c", "c").collect()] == ["c"]
    photos = spark.createDataFrame([("1", "x\\a.jpg", 0), ("2", "x/a.jpg", 1), ("3", "", 2)], "id string, path string, seq long")
    clips = spark.createDataFrame([("9", "x/a.jpg", 0), ("8", "v.mp4", 1)], "id string, path string, seq long")
    assert sorted(r.id for r in L.combined_media(photos, clips).collect()) == ["1", "3", "8"]
    assert sorted(r.id for r in L.combined_media(photos, clips, "videos").collect()) == ["8", "9"]


def test_linking_counts_a_person_once_per_video(spark):
    det = spark.createDataFrame(
        [(1, 5, [1.0, 0.0], 0.9), (2, 5, [1.0, 0.01], 0.9), (3, 5, [0.0, 1.0], 0.9), (4, 6, [0.0, 1.0], 0.9), (5, 6, [1.0, 0.0], 0.1)],
        "det_id long, video_id long, embedding array<float>, det_score double",
    ).select("*", F.lit(None).cast("double").alias("yaw"), *[F.lit(v).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 30), ("y2", 30))], F.lit(50.0).alias("blur_var"))
    faces = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "person_id long, embedding array<float>")
    linked, fresh = I.link_faces(det, faces, 20)
    assert {(r.det_id, r.person_id) for r in linked.collect()} == {(1, 7), (3, 20), (4, 20)}
    assert [r.id for r in fresh.collect()] == [20]


def test_core_plans(spark):
    from reelgraph.operators import search as S

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "seq")
    plan = S.knn(v.withColumnRenamed("seq", "query_id"), v, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
    below = plan.split("MapInArrow")[1]
    assert "Exchange" not in below and "label" not in below.split("ReadSchema")[-1]


@pytest.mark.parametrize("order", [("name", "id"), ("turn", "id"), ("same", "id")])
def test_pages_far_into_a_list(spark, monkeypatch, order):
    monkeypatch.setattr(L, "PAGE_ROWS", 20)
    monkeypatch.setattr(L, "RANGES", 8)
    df = spark.range(400).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 31)).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (-F.col("id") % 50).cast("int")).alias("turn"), F.lit(1).alias("same"),
    ).repartition(5)
    want = [r.id for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 5), (100, 7), (255, 40), (396, 10), (400, 3), (900, 3), (0, 400)):
        assert [r.id for r in L.page(df, offset, limit, *order).collect()] == want[offset: offset + limit]
    far = L.page(df, 300, 5, *order)
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and far.columns == df.columns
    assert L.page(df.filter("id < 0"), 100, 5, *order).count() == 0


def test_genuine_scores_leave_tile_by_tile(spark, monkeypatch):
    rows = np.random.default_rng(4).normal(size=(90, 6))
    items = D.frame(spark, rows).withColumn("identity", F.when(F.col("seq") < 70, 1).when(F.col("seq") < 88, F.col("seq") % 2 + 2))
    monkeypatch.setattr(E, "COUNTED_ROWS", 16)
    found = {r.score: r.n for r in E.genuine_scores(items).collect()}
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    groups = [range(70), range(70, 88, 2), range(71, 88, 2)]
    want = sorted(float(np.round(unit[a] @ unit[b], 12)) for g in groups for a in g for b in g if a < b)
    assert np.allclose(sorted(s for s, n in found.items() for _ in range(n)), want, atol=1e-6)


def test_gallery_of_one_person_with_most_faces(spark, monkeypatch):
    monkeypatch.setattr(G, "STRETCH_ROWS", 50)
    faces = spark.range(1000).select(
        "id", (F.col("id") % 7).alias("video_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("person_id"),
        F.concat(F.lit("f"), F.col("id")).alias("thumbnail_path"), F.lit(0.5).alias("confidence"),
    )
    videos = spark.range(7).select("id", F.lit("a/b.mp4").alias("path"))
    plan = G.nested_gallery(faces, videos, chunk=30)
    got = {(r.person_id, r.chunk): sorted(int(f.thumbnail[1:]) for f in r.faces) for r in plan.collect()}
    want = {}
    for person in ("None", "0", "1", "2"):
        own = [i for i in range(1000) if ("None" if i % 10 else str(i % 3)) == person]
        want |= {(person, k // 30): own[k:k + 30] for k in range(0, len(own), 30)}
    assert got == want
    assert "_stretch" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_of_a_stream_is_many_files(spark, tmp_path, monkeypatch):
    from reelgraph.plans import streams
    from reelgraph.plans.tables import Tables

    spark.range(600).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        monkeypatch.setattr(streams, "scratch", lambda t: f"{tmp_path}/scratch")
        source = streams.stream(Tables(spark, str(tmp_path)), "documents")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sizes = []
    query = source.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == 600 and min(sizes) > 100
    assert len(list(tmp_path.glob("scratch/documents/*.parquet"))) >= 6
