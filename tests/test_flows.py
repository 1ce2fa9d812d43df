from pyspark.sql import functions as F

from reelgraph.operators.frames import frame_rows
from reelgraph.plans import flows as W

WORDS = ("cat", "dog", "sky")


def words():
    """Stand-in text and image encoder: which of a few words occur."""

    def encode(inputs):
        texts = [x.decode() if isinstance(x, bytes | bytearray) else x for x in inputs]
        return [[float(t.count(w)) + 0.01 for w in WORDS] for t in texts]

    return encode


def photos(spark, rows):
    df = spark.createDataFrame([(p, len(c), c.encode()) for p, c in rows], "path string, length long, content binary")
    return df.withColumn("modification_time", F.lit("2024-01-01").cast("timestamp"))


def detect(new):
    """Every word "cat" is a face."""
    hits = new.filter(F.col("content").cast("string").contains("cat"))
    box = [F.lit(v).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 9), ("y2", 9), ("det_ord", 0))]
    return hits.select("path", *box, F.array(F.lit(1.0), F.length("content") * 0.001).alias("embedding"))


def empty(spark):
    from reelgraph import schemas as T

    return W.PhotoTables(*[spark.createDataFrame([], s) for s in (T.VECTORS, T.VECTORS, T.SCANNED_EMPTY, T.PEOPLE, T.PERSON_PHOTOS)])


def test_photo_pass_then_search(spark):
    first = photos(spark, [("a.jpg", "cat"), ("b.jpg", "dog dog"), ("c.jpg", "cat sky")])
    seen = []

    def counted(new):
        seen.append(sorted(r.path for r in new.select("path").collect()))
        return detect(new)

    one = W.index_photos(empty(spark), first, counted, words, "m")
    assert one.face_vectors.count() == 2 and one.semantic_vectors.count() == 3
    assert [r.path for r in one.scanned_empty.collect()] == ["b.jpg"]
    assert one.people.count() == 1 and one.person_photos.count() == 2
    again = W.index_photos(one, first, counted, words, "m")
    assert again.semantic_vectors.count() == 3 and again.people.count() == 1
    changed = photos(spark, [("b.jpg", "dog dog cat"), ("c.jpg", "cat sky")])
    third = W.index_photos(again, changed, counted, words, "m")
    assert seen == [["a.jpg", "b.jpg", "c.jpg"], [], ["b.jpg"]]
    assert sorted(r.path for r in third.face_vectors.collect()) == ["b.jpg", "c.jpg"]
    queries = spark.createDataFrame([(1, "dog"), (2, "  ")], "query_id long, text string")
    hits = W.search_photos(queries, one.semantic_vectors, words).join(one.semantic_vectors.select(F.col("seq").alias("id"), "path"), "id")
    assert hits.orderBy("rank").first().path == "b.jpg" and {r.query_id for r in hits.collect()} == {1}


def test_video_analysis_then_search(spark):
    rows = [(v, i, [float((i * 7 + j) % 5) for j in range(8)], text.encode()) for v, text in ((1, "cat"), (2, "dog sky")) for i in range(6)]
    frames = spark.createDataFrame(rows, "video_id long, frame_idx int, hist array<double>, content binary")
    videos = spark.createDataFrame([(1,), (2,)], "id long")
    labels = spark.createDataFrame([(w, i, [float(i == j) for j in range(3)]) for i, w in enumerate(WORDS)], "label string, label_ord int, embedding array<float>")
    out = W.analyse_videos(videos, frames, words, labels).cache()
    assert {r.id: r.label for r in out.collect()}[1] == "cat"
    stored = frame_rows(out, 3)
    queries = spark.createDataFrame([(1, " Cat "), (2, "")], "query_id long, text string")
    hits = W.search_videos(queries, stored, words).orderBy("rank").collect()
    assert hits[0].id == 1 and {h.query_id for h in hits} == {1}


def test_changed_model_leaves_one_model(spark):
    files = photos(spark, [("a.jpg", "cat"), ("b.jpg", "dog dog"), ("a_1700000000000.jpg", "cat")])
    one = W.index_photos(empty(spark), files, detect, words, "m1")
    assert sorted(r.path for r in one.semantic_vectors.collect()) == ["a.jpg", "b.jpg"]
    two = W.index_photos(one, files, detect, words, "m2")
    assert {(r.path, r.model_id) for r in two.semantic_vectors.collect()} == {("a.jpg", "m2"), ("b.jpg", "m2")}


def test_video_pass(spark, tmp_path):
    from reelgraph import schemas as T
    from reelgraph.sources.table_store import TableStore

    store = TableStore(spark, f"file://{tmp_path}/registry")
    assert store.version() is None
    names = {"videos": T.VIDEOS, "faces": T.FACES, "persons": T.PERSONS, "meta": T.META}
    store.write({n: spark.createDataFrame([], s) for n, s in names.items()})
    labels = spark.createDataFrame([(w, i, [float(i == j) for j in range(3)]) for i, w in enumerate(WORDS)], "label string, label_ord int, embedding array<float>")
    texts = {"a.mp4": "cat", "b.mp4": "dog sky"}
    rows = [(n, 30 * i, [float((i * 7 + j) % 5) for j in range(8)], t.encode()) for n, t in texts.items() for i in range(20)]
    frames = spark.createDataFrame(rows, "file_name string, frame_idx int, hist array<double>, content binary")
    found = [(1, "a.mp4", [1.0, 0.0]), (2, "b.mp4", [1.0, 0.01]), (3, "b.mp4", [0.0, 1.0])]
    detections = spark.createDataFrame(
        [(i, n, 0, 0, 0, 200, 200, 0.99, 0.0, 500.0, v) for i, n, v in found],
        "det_id long, file_name string, frame_idx int, x1 int, y1 int, x2 int, y2 int, det_score double, yaw double, blur_var double, embedding array<float>",
    )
    thumbs = spark.createDataFrame([("t/a.jpg",), ("t/b.jpg",)], "path string")

    def run(paths):
        files = spark.createDataFrame([(p,) for p in paths], "path string")
        out = W.index_videos(W.VideoTables(*(store.read(n) for n in names)), files, thumbs, frames, detections, words, labels)
        store.write({"videos": out.videos, "faces": out.faces, "persons": out.persons, "meta": out.meta})

    run(["up/a.mp4", "up/b.mp4"])
    videos = {r.path: r for r in store.read("videos").collect()}
    assert videos["up/a.mp4"].label == "cat" and {v.id for v in videos.values()} == {1, 2}
    assert store.read("faces").count() == 3 and store.read("persons").count() == 2
    run(["up/a.mp4"])  # b is gone, with its faces and the person that only it showed
    assert [r.id for r in store.read("videos").collect()] == [1] and store.read("persons").count() == 1
    run(["up/a.mp4", "up/b.mp4"])  # back again under a new id
    assert sorted(r.id for r in store.read("videos").collect()) == [1, 3]
    assert store.version() == 3
