import numpy as np
import pytest
import xxhash

from reelgraph.llm import simhash
from tests.llm import data


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = data.components(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, p, least.get(r)) for (doc, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


@pytest.mark.parametrize("block", [4, 16384])
def test_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = data.texts()
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(data.documents(spark)).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_small_table(spark):
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(data.table(spark, "documents")).collect()]
    assert sorted(got, key=repr) == expected(data.pairs(spark))


def test_empty_table(spark):
    assert simhash.near_duplicates(data.documents(spark, []).limit(0)).count() == 0


def test_equal_to_spark_hash(spark):
    row = spark.sql("select xxhash64('some words of text') as h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"some words of text", 42)


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3)).astype(np.uint64)
    fps = np.unique(base[:, None] ^ np.bitwise_xor.reduce(flips, 2))
    ranks = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(s)
    fps = fps[np.argsort(ranks)]
    for a, b in ((fps, fps), (fps[:700], fps[5::3]), (fps[:1], fps)):
        want = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
        got = np.zeros_like(want)
        for i, j in simhash.matches(simhash.Index(a), simhash.Index(b), 4):
            assert not got[i, j].any()
            got[i, j] = True
        assert (got == want).all()
