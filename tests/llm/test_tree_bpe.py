import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reelgraph.llm import tree_bpe
from tests.llm import data


@pytest.fixture(scope="module")
def library():
    ranks = tree_bpe.load(tree_bpe.vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.of, special_tokens={})


@pytest.fixture
def encoder():
    return tree_bpe.Encoder(tree_bpe.vocabulary(), tree_bpe.public_pattern())


def check(encoder, library, texts):
    flat, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        want = library.encode_ordinary(text or "")
        assert flat[end - n : end].tolist() == want
        assert encoder.decode(flat[end - n : end]) == (text or "").encode()


@pytest.mark.parametrize("abreast", [1, 16, 1 << 30])
def test_random_texts(encoder, library, monkeypatch, abreast):
    monkeypatch.setattr(tree_bpe, "ABREAST", abreast)
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "　", "\x1c", "\x85", "!", "the", "<|endoftext|>", "ñ", "²", "_", "🙂", "qzx"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)] + [t for _, t in data.texts()]
    check(encoder, library, texts)


def test_what_is_remembered_is_forgotten(encoder, library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "KNOWN", 50)
    monkeypatch.setattr(tree_bpe, "MATCHES", 7)
    for k in range(10):
        check(encoder, library, [data.prose(60, k), data.prose(20, 3)])
        assert len(encoder.known) < 50 + 80


def test_long_matches(encoder, library):
    """Runs on which the library gives up, and those on which it does not."""
    check(encoder, library, ["x" * 3000, "ab" * 50000, " " * 5000, "\n" * 5000 + "x", "é" * 9999])
    for text in (" " * 1_000_000, "\n" * 1_000_000, "y" * 1_000_000):
        flat, counts = encoder.encode([text])
        assert encoder.decode(flat) == text.encode() and counts.tolist() == [len(flat)]
        sub = library.encode_ordinary(text[:1000])
        assert set(flat.tolist()) <= set(sub) | set(library.encode_ordinary(text[:1001]))


def plain(ranks, word):
    """One merge at a time over all pairs, by the bytes that a pair makes."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("abreast", [1, 1 << 30])
def test_ranks_that_no_training_made(tmp_path, monkeypatch, abreast):
    """Tokens of many parts, ranks in any order, merges that lower the least rank: pairs count by the bytes they make."""
    monkeypatch.setattr(tree_bpe, "ABREAST", abreast)
    rng = random.Random(9)
    tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(80)}
    tokens = sorted(tokens)
    rng.shuffle(tokens)
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(tokens)))
    ranks = tree_bpe.load(str(path))
    words = [bytes(rng.choices(b"abcd", k=rng.randint(1, 70))) for _ in range(400)]
    ids, counts = tree_bpe.merged(ranks, words)
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == ([ranks.of[word]] if word in ranks.of else plain(ranks.of, word))


def test_a_rank_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "few"
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError, match="no token"):
        tree_bpe.Ranks(str(path))


def test_tables(spark, library):
    for df, rows in ((data.documents(spark), data.texts()), (data.table(spark, "documents"), data.pairs(spark))):
        got = sorted((tuple(r) for r in tree_bpe.digests(df).collect()), key=repr)
        want = []
        for i, t in rows:
            ids = library.encode_ordinary(t or "")
            raw = np.array(ids, "<u4").tobytes()
            want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert tree_bpe.digests(data.documents(spark, [])).count() == 0
