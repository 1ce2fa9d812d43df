import math
from fractions import Fraction

import numpy as np
import pytest

from reelgraph.llm import whitening
from tests.llm import data


def fit_rows(rows):
    return [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]


def expected(rows):
    """Exact means and deviations, covariances from fractions, eigenvectors of those: one width."""
    rows = fit_rows(rows)
    x = [[math.floor(1024 * Fraction(float(np.float32(c)))) + 100000 for c in v] for _, v in rows]
    n, width = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(width)]
    off = [[n * r[d] - s[d] for d in range(width)] for r in x]
    cov = np.array([[float(Fraction(sum(o[a] * o[b] for o in off), n**3)) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(cov)
    return [i for i, _ in rows], [sum(o * o for o in r) for r in off], np.array(off, float) / n, cov, values[::-1], vectors[:, ::-1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, width string, z int").repartition(3)


def check(df, rows):
    ids, deviations, centred, cov, values, vectors = expected(rows)
    got = df.collect()
    k = min(8, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == k * len(ids) and {r["n"] for r in got} == {len(ids)}
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(zip(ids, deviations, strict=True))
    z = np.zeros((len(ids), k))
    places = {i: [p for p, j in enumerate(ids) if j == i] for i in ids}  # repeated rows are equal
    for r in got:
        z[places[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign(z[:, c] @ want[:, c])
        assert np.abs(sign * z[:, c] - want[:, c]).max() < 1e-8
    assert np.abs(z.T @ z / len(ids) - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("step", [7, 4096])
def test_odd_vectors(spark, monkeypatch, step):
    monkeypatch.setattr(whitening, "ROWS", step)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=10) * np.arange(1, 11)).tolist()) for k in range(90)]
    bad = [(200, None), (201, []), (202, [None] * 10), (203, [float("nan")] + [0.0] * 9), (204, [float("inf")] * 10)]
    same = [(300, [0.5] * 10), (301, [0.5] * 10), (301, [0.5] * 10), (302, [0.0] * 10), (303, [-50.25] + [0.0] * 9)]
    check(whitening.whiten(frame(spark, rows + bad + same)), rows + same)


def test_small_table(spark):
    df = data.table(spark, "embeddings")
    check(whitening.whiten(df), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_sums_of_squares_are_exact_beyond_longs():
    y = np.array([[3_000_000_000, -2_999_999_999], [7, 2_000_000_001]], np.int64)
    out = whitening.squares(y)
    rows = y.tolist()
    assert out[0, 0] == sum(a * a for a, _ in rows) and out[0, 1] == sum((a + b) ** 2 for a, b in rows)


def test_huge_numbers(spark):
    rows = [(k, [float(k * 10.0**30), float(k % 3), 1.0]) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == set(range(5)) and any(r["deviation"] is None for r in got)
    assert whitening.grid(np.array([1e300, -1e300, 1e308, 2.0**40])).tolist()[3] == 2**50 + 100000


def test_nothing_and_no_spread(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0]) for k in range(4)])).count() == 0


def test_two_widths_are_two_lists(spark):
    rng = np.random.default_rng(5)
    one = [(k, rng.normal(size=3).tolist()) for k in range(20)]
    two = [(100 + k, rng.normal(size=5).tolist()) for k in range(30)]
    got = whitening.whiten(frame(spark, one + two)).cache()
    check(got.filter("vec_id < 100"), one)
    check(got.filter("vec_id >= 100"), two)


def test_too_many_sums_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_SUMS", 5)
    with pytest.raises(ValueError, match="covariances"):
        whitening.whiten(frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [0.0, 1.0, 2.0])]))
