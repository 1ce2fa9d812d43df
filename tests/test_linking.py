import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.operators import linking
from reelgraph.sources.table_store import Conflict, TableStore
from reelgraph.streaming import ingest
from tests import data


def one_by_one(rows, known, next_person, threshold=0.32):
    """(id, person, stored) of each row (id, video, vector) in order, with everything in lists."""
    registry = [(p, data.unit([v])[0]) for p, v in sorted(known, key=lambda x: x[0])]
    done, linked = [], set()
    for i, video, v in sorted(rows, key=lambda r: r[0]):
        u = data.unit([v])[0]
        seen = [(round(float(u @ e), 12), p) for p, e in registry]
        seen += [(round(float(u @ e), 12), p) for _, w, e, p, stored in done if stored or w == video]
        top = max((s for s, _ in seen), default=-1)
        person = next((p for s, p in seen if s == top), None) if top >= threshold else None
        if person is None:
            person, next_person = next_person, next_person + 1
        done.append((i, video, u, person, (video, person) not in linked))
        linked.add((video, person))
    return [(i, p, s) for i, _, _, p, s in done]


def detections(spark, rows):
    df = spark.createDataFrame([(i, v, [float(x) for x in e]) for i, v, e in rows], "det_id long, video_id long, embedding array<double>")
    constants = {"det_score": 0.9, "x1": 0, "y1": 0, "x2": 30, "y2": 30, "blur_var": 50.0}
    return df.withColumns({k: F.lit(v) for k, v in constants.items()}).withColumn("yaw", F.lit(None).cast("double"))


def registry(spark, known):
    return spark.createDataFrame([(p, [float(x) for x in v]) for p, v in known], "person_id long, embedding array<double>")


def people(seed, n, dim=48, walks=40):
    """Faces of many people, and chains in which each face resembles the one before more than the others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    rows = [centres[k] + 1.1 * rng.normal(size=dim) for k in rng.integers(0, len(centres), n - 20 * walks)]
    for _ in range(walks):
        v = rng.normal(size=dim)
        for _ in range(20):
            v = 0.55 * v / np.linalg.norm(v) + 0.8 * (lambda x: x / np.linalg.norm(x))(rng.normal(size=dim))
            rows.append(v)
    order = rng.permutation(len(rows))
    rows = [(int(i), int(rng.integers(0, n // 15)), rows[k]) for i, k in enumerate(order)]
    rows[5] = (5, rows[4][1], rows[4][2])  # the same face again, in the same video
    rows[9] = (9, rows[9][1], np.zeros(dim))
    return rows, [(int(p), centres[p % len(centres)] + 0.3 * rng.normal(size=dim)) for p in range(60)]


@pytest.mark.parametrize("task_rows", [4096, 700, 150])
def test_two_thousand_detections_as_one_by_one(spark, task_rows):
    rows, known = people(1, 2000)
    want = one_by_one(rows, known, 500)
    linked, fresh, seen = linking.link_faces_in_order(detections(spark, rows), registry(spark, known), 500, task_rows=task_rows)
    assert sorted((r.det_id, r.person_id, r.stored) for r in seen.collect()) == want
    assert sorted((r.det_id, r.person_id) for r in linked.collect()) == [(i, p) for i, p, stored in want if stored]
    assert sorted(r.id for r in fresh.collect()) == sorted({p for _, p, _ in want if p >= 500})
    assert sum(not s for _, _, s in want) > 20 and len({p for _, p, _ in want if p < 500}) > 20


def test_nothing(spark):
    linked, fresh, seen = linking.link_faces_in_order(detections(spark, []), registry(spark, []), 1)
    assert linked.count() == fresh.count() == seen.count() == 0


def test_batches_and_failures(spark, tmp_path):
    """Batches give what one pass gives, also when one fails after its tables are written, and when one comes again."""
    rows, known = people(2, 500, dim=24, walks=5)
    want = one_by_one(rows, known, 500)
    store = TableStore(spark, f"file://{tmp_path}/registry")
    ingest.start_registry(store, registry(spark, known), 500)
    link = ingest.link_batch(store)
    batches = [detections(spark, rows[k : k + 125]) for k in range(0, 500, 125)]
    publish, calls = store._publish, []

    def failing(version, content):
        if len(calls) == 1:
            calls.append("failed")
            raise OSError("the driver goes before the commit")
        calls.append(version)
        publish(version, content)

    store._publish = failing
    done = 0
    for k, batch in enumerate(batches):
        try:
            done += link(batch, k)
        except OSError:
            assert store.version() == 1 and store.facts()["batch"] == 0
            done += link(batch, k)
        assert link(batch, k) == 0 and store.version() == k + 1  # it came again after the commit
    assert calls == [1, "failed", 2, 3, 4]
    got = sorted((r.det_id, r.person_id) for r in store.read("linked").collect())
    assert got == [(i, p) for i, p, stored in want if stored] and done == len(got)
    assert sorted(r.id for r in store.read("persons").collect()) == sorted({p for _, p, _ in want if p >= 500})
    assert store.read("faces").count() == len(known) + len(got)


def test_of_two_writers_one_is_told(spark, tmp_path):
    store, other = (TableStore(spark, f"file://{tmp_path}/t") for _ in range(2))
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    store.write({"a": numbers(1)})
    base = other.version()
    store.write({"a": numbers(2)})
    with pytest.raises(Conflict):
        other.write({"a": numbers(3)}, base=base)
    assert [r.n for r in store.read("a").collect()] == [2] and store.version() == 1
    for k in range(5):
        store.write({}, append={"a": numbers(k)}, facts={"k": k})
    assert sorted(r.n for r in store.read("a").collect()) == [0, 1, 2, 2, 3, 4] and store.facts() == {"k": 4}
    assert len(store.versions()) == 2


def test_many_folders_are_put_together(spark, tmp_path, monkeypatch):
    from reelgraph.sources import table_store

    monkeypatch.setattr(table_store, "FOLDERS", 3)
    store = TableStore(spark, f"file://{tmp_path}/t")
    for k in range(6):
        store.write({}, append={"a": spark.createDataFrame([(k,)], "n long")})
        assert len(store.commit()["tables"]["a"]) <= 3
    assert sorted(r.n for r in store.read("a").collect()) == list(range(6))


def test_heads_grow(spark, monkeypatch):
    rows, known = people(3, 500, dim=24, walks=5)
    heads, settle = [], linking._in_order

    def counted(threshold):
        heads.append(threshold)
        return settle(threshold)

    monkeypatch.setattr(linking, "_in_order", counted)
    # Everything hangs together at 0, so that one group goes on in heads of 8, 16, 32, ...
    _, _, seen = linking.link_faces_in_order(detections(spark, rows), registry(spark, known), 500, threshold=0.0, task_rows=8, broadcast_bytes=0)
    assert sorted((r.det_id, r.person_id, r.stored) for r in seen.collect()) == one_by_one(rows, known, 500, 0.0)
    assert len(heads) <= 1 + 7
