import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.llm import language, quality
from reelgraph.llm.common import crc_fold
from tests.llm import data

MEDIUM = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = language._start(["a", "b", "c"], h=3)
    w = {k: v.astype("f8") for k, v in model.w.items()}
    codes = rng.integers(0, 257, (5, 4))
    target = rng.integers(0, 3, 4)
    _, grads = language.gradients(w, codes, target)
    for name, at in (("xf", (int(codes[1, 0]), 4)), ("uf", (1, 5)), ("ub", (2, 0)), ("xb", (int(codes[2, 1]), 7)), ("o", (3, 1)), ("c", (2,))):
        old, eps = w[name][at], 1e-2
        w[name][at] = old + eps
        up, _ = language.gradients(w, codes, target)
        w[name][at] = old - eps
        down, _ = language.gradients(w, codes, target)
        w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


def test_every_position_is_labelled():
    model = language._start(["a", "b"])
    text = bytes(range(1, 200)) * 5
    p = language.pooled(model, [text, b"", text[:10]])
    assert p.shape == (3, 2) and p[0].sum() == pytest.approx(1, abs=1e-4) and p[1].sum() == 0


def test_language_on_held_out_rows(spark):
    docs = data.table(spark, "documents", MEDIUM)
    rows = language.identify(docs, crc_fold("doc_id", 3) == 1).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_of_odd_documents(spark):
    rows = language.identify(data.documents(spark), crc_fold("doc_id", 3) == 1).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(data.texts())
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (5, 6, 7, 18))
    assert by[9]["lang_pred"] != "und"
    assert language.identify(data.documents(spark, []), F.lit(False)).count() == 0


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_rows(spark):
    docs, labels = data.table(spark, "documents", MEDIUM), data.table(spark, "labels", MEDIUM)
    scored = quality.classify(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert auc([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.9
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (14, 0), (17, 0), (18, 0), (21, 1), (99, 1), (None, 1), (4, 7), (8, None)], "doc_id long, quality int")
    rows = quality.classify(data.documents(spark), labels).collect()
    assert len(rows) == len(data.texts()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = [r["score"] for r in rows if r["doc_id"] in (5, 6, 7)]
    assert len(set(empty)) == 1
    none = labels.filter("false")
    assert {r["score"] for r in quality.classify(data.documents(spark), none).collect()} == {0.5}
    assert quality.classify(data.documents(spark, []), labels).count() == 0


def test_weights_under_the_bound_are_zero():
    rng = np.random.default_rng(0)
    examples = [(np.array([1 + k % 2, int(rng.integers(10, 1000))]), k % 2) for k in range(200)]
    model = quality.train(examples)
    assert model.score(np.array([2])) > 0.8 > 0.2 > model.score(np.array([1]))
    assert (model.weights[2000:] == 0).all()
