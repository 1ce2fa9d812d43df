import math

import numpy as np
import pytest

from reelgraph.llm import embeddings
from tests.llm import data


def expected(rows, cosine=0.93):
    def fit(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for i, (a, la, v) in enumerate(rows):
        for j in range(i):
            b, lb, w = rows[j]
            if None in (a, b, la) or la != lb or not fit(v) or not fit(w) or len(v) != len(w):
                continue
            x, y = np.array(v, "f4").astype(float), np.array(w, "f4").astype(float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links.append((i, j))
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    roots = data.components(len(rows), links)
    least = {}
    for (a, _, _), r in zip(rows, roots, strict=True):
        if a is not None:
            least[r] = min(a, least.get(r, a))
    out = [(a, c, least.get(r), a is not None and a == least.get(r)) for (a, _, _), c, r in zip(rows, n, roots, strict=True)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rep string")


def check(df, rows):
    assert sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("block, pivots", [(3, (1, 4, 16, 64)), (2048, (64,)), (4, (5,))])
def test_odd_vectors(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PIVOTS", pivots)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    near = base[rng.integers(0, 6, 60)] + rng.normal(scale=0.25, size=(60, 8))
    rows = [(k, k % 2, v.tolist()) for k, v in enumerate(near)]
    same = base[0].tolist()
    rows += [(100 + k, 0, same) for k in range(12)] + [(200, None, same), (None, 0, same), (201, 0, None), (202, 0, [0.0] * 8)]
    rows += [(203, 0, [float("nan")] + same[1:]), (204, 0, [None, *same[1:]]), (205, 0, []), (206, 0, [float("inf")] * 8), (5, 1, same)]
    rows += [(207, 0, [3 * x for x in same]), (207, 0, [3 * x for x in same])]
    check(frame(spark, rows), rows)


def test_small_table(spark):
    df = data.table(spark, "embeddings")
    check(df, [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])


def test_nothing(spark):
    assert embeddings.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None, [1.0]), (2, 0, None)]
    check(frame(spark, rows), rows)


@pytest.mark.parametrize("wide, pivots", [(4, (1, 4, 16, 64)), (8, (3,))])
def test_two_widths(spark, monkeypatch, wide, pivots):
    monkeypatch.setattr(embeddings, "PIVOTS", pivots)
    rng = np.random.default_rng(7)
    rows = []
    for width, n in ((4, 12), (8, wide), (1, 3)):
        base = rng.normal(size=width)
        rows += [(100 * width + k, 0, (base + 0.1 * rng.normal(size=width)).tolist()) for k in range(n)]
    check(frame(spark, rows), rows)


def test_pivots_are_taken_where_they_prune():
    rng = np.random.default_rng(8)
    centres = 10 * np.eye(16)
    apart = centres[rng.integers(0, 16, 2000)] + 0.1 * rng.normal(size=(2000, 16))
    radius = (2 - 2 * embeddings.COSINE) ** 0.5
    assert len(embeddings.worthwhile_pivots(apart, radius, 1e6)) == 16
    assert len(embeddings.worthwhile_pivots(rng.normal(size=(2000, 64)), radius, 1e4)) == 1
