import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.functions import media as M
from reelgraph.sources import encoders as EN
from reelgraph.sources import files as SF
from reelgraph.sources import vector_table as VT
from reelgraph.streaming import ingest as N


def touch(folder, *names, content=b"xy"):
    for name in names:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def two_bytes():
    """Encoder of the first two bytes; refuses batches that hold an empty file."""

    def encode(inputs):
        if any(len(x) == 0 for x in inputs):
            raise ValueError("unreadable")
        return [[float(x[0]), float(x[1])] for x in inputs]

    return encode


def test_photo_and_video_scan(spark, tmp_path):
    touch(tmp_path, "b.JPG", "a.png", "c.txt", "d.mp4", "sub/e.MKV", "sub/f.jpeg")
    assert [r.path for r in SF.photo_files(spark, str(tmp_path)).collect()] == ["test_images/a.png", "test_images/b.JPG"]
    videos = sorted(r.path.split("/")[-1] for r in SF.video_files(spark, str(tmp_path)).collect())
    assert videos == ["d.mp4", "e.MKV"]
    assert SF.video_files(spark, str(tmp_path / "d.mp4")).count() == 1
    sig = SF.file_signatures(SF.photo_files(spark, str(tmp_path))).first()
    assert sig["size"] == 2 and sig.mtime_ns > 0
    plan = SF.photo_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_vector_table_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2, 512)).astype(np.float32)
    df = spark.createDataFrame(
        [(p, i, [float(x) for x in r]) for i, (p, r) in enumerate(zip(("a.jpg", "b.jpg"), rows, strict=True))],
        "path string, seq long, embedding array<float>",
    )
    table = str(tmp_path / "vectors")
    VT.write_vectors(df, table, "face", "m1")
    VT.write_vectors(df.limit(1), table, "semantic", "m2")
    back = {r.path: np.array(r.embedding) for r in VT.read_vectors(spark, table, "face", "m1").collect()}
    for path, row in zip(("a.jpg", "b.jpg"), rows, strict=True):
        assert np.allclose(back[path], row / np.linalg.norm(row), atol=1e-6)
    plan = VT.read_vectors(spark, table, "face")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    VT.write_vectors(df.limit(1), table, "face", "m1", mode="overwrite")
    assert VT.read_vectors(spark, table).groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 1
    assert VT.read_vectors(spark, table, "semantic").count() == 1
    VT.write_manifest(df, str(tmp_path / "manifest"))
    assert VT.read_manifest(spark, str(tmp_path / "manifest")).count() == 2
    assert VT.next_seq(df) == 2 and VT.next_seq(df.limit(0)) == 0


def test_encoder_keeps_keys_and_marks_unreadable(spark):
    rows = [(i, None if i == 3 else (b"" if i == 7 else bytes([i, 1]))) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, content binary").repartition(3)
    got = {r.id: r.embedding for r in EN.embed(df, "id", "content", two_bytes, batch_size=4).collect()}
    assert len(got) == 30 and got[3] is None and got[7] is None
    assert all(got[i] == pytest.approx([i / np.hypot(i, 1), 1 / np.hypot(i, 1)], abs=1e-5) for i in (0, 6, 29))


def test_watch_index_until_quiet(spark, tmp_path):
    library, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    touch(library, "a.jpg", "sub/b.png", "notes.txt")
    stored = N.stored_rows(spark, table, "path string, embedding array<float>")

    def start():
        return N.index_new_images(N.watch_images(spark, library), two_bytes, table, state)

    assert N.index_until_quiet(start, stored) == 1
    assert stored() == 2
    touch(library, "c.JPEG")
    assert N.index_until_quiet(start, stored) == 1
    assert stored() == 3
    assert N.index_until_quiet(start, stored) == 0


class Quick:
    def awaitTermination(self):
        pass


def test_passes_go_on_until_quiet():
    left, done = [1] * 37, []

    def start():
        if left:
            done.append(left.pop())
        return Quick()

    assert N.index_until_quiet(start, lambda: len(done)) == 37


def test_folded_average_keeps_state_between_runs(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "job string, seq long, items long, seconds double"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        state = N.folded_average(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
        return {r.job: (r.rate, r.n) for r in state.collect()}

    spark.createDataFrame([("a", 0, 27, 10.0)], schema).write.parquet(f"{src}/one")
    assert run() == {"a": (pytest.approx(2.7), 1)}
    assert run() == {"a": (pytest.approx(2.7), 1)}
    spark.createDataFrame([("a", 1, 45, 10.0), ("b", 2, 1, 1.0)], schema).write.parquet(f"{src}/two")
    assert run() == {"a": (pytest.approx(0.7 * 2.7 + 0.3 * 4.5), 2), "b": (1.0, 1)}
    spark.createDataFrame([("b", 3, 1, 1.0)], schema).write.parquet(f"{src}/three")
    assert run()["b"] == (pytest.approx(1.0), 2)
    assert sorted(p.name for p in (tmp_path / "state").glob("batch=*")) == ["batch=1", "batch=2"]


def test_drain_finishes_once(spark, tmp_path):
    touch(tmp_path / "in", "a.jpg", "b.jpg", "c.jpg")
    seen, done = [], []
    stream = N.watch_images(spark, str(tmp_path / "in"), max_files=1).select("path")
    n = N.drain(stream, lambda b, i: seen.append(b.count()) or seen[-1], lambda: done.append(1), str(tmp_path / "ck"))
    assert n == 3 and seen == [1, 1, 1] and done == [1]


def test_drain_counts_all_of_many_batches(spark, tmp_path):
    touch(tmp_path / "in", *(f"{k}.jpg" for k in range(110)))
    stream = N.watch_images(spark, str(tmp_path / "in"), max_files=1).select("path")
    assert N.drain(stream, lambda b, i: 1, lambda: None, str(tmp_path / "ck")) == 110


@pytest.mark.parametrize(
    ("rate", "seconds", "frames"), [(4, 10, 5), (4, 600, 8), (4, 1, 4), (200, 10, 5), (200, 600, 14), (200, None, 14)]
)
def test_frame_budget(spark, rate, seconds, frames):
    row = spark.range(1).select(M.frame_budget(F.lit(float(rate)), F.lit(seconds).cast("double")).alias("n")).first()
    assert row.n == frames


def test_pick_evenly(spark):
    cases = [(10, 4), (3, 5), (14, 1), (0, 3), (9, 9), (100, 7)]
    df = spark.createDataFrame(cases, "n int, k int")
    for r in df.select("n", "k", M.pick_evenly(F.col("n"), F.col("k")).alias("i"), M.sample_indices(F.col("n"), F.col("k")).alias("s")).collect():
        want = list(range(r.n)) if r.k >= r.n else sorted(set(np.linspace(0, r.n - 1, r.k).round().astype(int).tolist()))
        assert r.i == want
        assert r.s == (np.linspace(0, r.n - 1, r.k).astype(int).tolist() if r.n else [])


def test_playable(spark):
    rows = [
        ("a.mp4", "Stream #0:0: Video: h264 (High), yuv420p(tv), 640x480\nStream #0:1: Audio: aac (LC)", True),
        ("a.avi", "Video: mpeg4, yuv420p", False), ("b.MP4", "Video: H264, yuv420p", True), ("c.mp4", "nothing", False),
        ("d.webm", "Video: vp9, gbrp, 1x1\nAudio: opus", False), ("e.webm", "Video: vp9, yuv420p\nAudio: wmav2", False),
    ]
    df = spark.createDataFrame(rows, "path string, t string, want boolean")
    t = F.col("t")
    ok = M.is_playable(F.col("path"), M.probe_video_codec(t), M.probe_pixel_format(t), M.probe_audio_codec(t))
    assert df.filter(ok != F.col("want")).count() == 0


def test_prompts_are_not_broadcast(spark):
    from reelgraph.functions.text import expand_queries
    from reelgraph.sources import encoders as EN

    asked = spark.createDataFrame([(1, "red car"), (2, "Paris"), (3, "red car")], "query_id long, text string")
    encoded = EN.embed_prompts(expand_queries(asked), lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert "SortMergeJoin" in encoded._jdf.queryExecution().executedPlan().toString()
    found = {(r.query_id, r.prompt): r.embedding for r in encoded.collect()}
    assert found[1, "red car"] == found[3, "red car"] and {q for q, _ in found} == {1, 2, 3}


def test_queries_are_stripped_once_and_prompts_meet_before_they_are_added_up(spark):
    from reelgraph.functions.text import expand_queries
    from reelgraph.sources import encoders as EN

    rows = [(1, " \tred car\n"), (2, "Paris"), (3, "red car"), (4, "  "), (5, None), (5, "apple"), (5, "apple")]
    prompts = expand_queries(spark.createDataFrame(rows, "query_id long, text string"))
    assert prompts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    encoded = EN.embed_prompts(prompts, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    pooled = EN.query_vectors(encoded)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    first = plan.splitlines().index(next(x for x in plan.splitlines() if "partial_aggregate_metrics" in x))
    assert any("Exchange hashpartitioning(query_id" in x for x in plan.splitlines()[first:])
    found = {r.query_id: r.embedding for r in pooled.collect()}
    assert set(found) == {1, 2, 3, 5} and found[1] == pytest.approx(found[3])
    texts = ["Paris", *(f"{x} Paris" for x in ("a photo of a", "a photograph of a", "a picture of a", "a close-up photo of a", "a photo of the", "a photo of"))]
    units = np.array([[len(x), 1.0] for x in texts])
    mean = (units / (np.linalg.norm(units, axis=1, keepdims=True) + 1e-6)).mean(axis=0)
    assert found[2] == pytest.approx(list(mean / (np.linalg.norm(mean) + 1e-6)), abs=1e-6)


def test_part_rows_are_dealt_out_before_they_become_prompts(spark, tmp_path):
    from reelgraph.plans.columns import part_queries
    from reelgraph.plans.tables import Tables

    parts = spark.createDataFrame([(k, f"red car {k}", "LARGE") for k in range(40)], "p_partkey long, p_name string, p_type string")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    queries = part_queries(Tables(spark, str(tmp_path)))
    assert queries.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r.query_id for r in queries.collect()) == list(range(160))
