import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reelgraph.llm import bpe, libraries, packing
from tests.llm import data


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_random_texts(tokenizer):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "　", "\x1c", "\x85", "!", "the", "<|endoftext|>", "ñ", "²", "_", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(2000)] + [t for _, t in data.texts()]
    encoder = bpe.Encoder(bpe.vocabulary())
    flat, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        want = ids_of(tokenizer, text)
        assert flat[end - n : end].tolist() == want
        assert encoder.decode(flat[end - n : end]) == tokenizer.decode(want, skip_special_tokens=False)


def test_round_trip(spark, tokenizer):
    for df, rows in ((data.documents(spark), data.texts()), (data.table(spark, "documents"), data.pairs(spark))):
        done = bpe.decoded(bpe.encoded(df)).collect()
        got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in done), key=repr)
        assert got == sorted(((i, ids_of(tokenizer, t), t or "") for i, t in rows), key=repr)
    assert bpe.digests(data.documents(spark, [])).count() == 0


def test_merges_out_of_order_are_refused(tmp_path):
    bad = tmp_path / "bad.json"
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    import json

    bad.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["ab c", "a b"]}, "added_tokens": []}))
    with pytest.raises((ValueError, KeyError)):
        bpe.Vocabulary(str(bad))


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(spark, tokenizer, length):
    for df, rows in ((data.documents(spark), data.texts()), (data.table(spark, "documents"), data.pairs(spark))):
        pieces = [r.asDict() for r in packing.pack(df, length=length).collect()]
        want = sorted((ids_of(tokenizer, t) + [1] for _, t in rows), key=repr)
        sequences = {}
        for p in pieces:
            ids = np.frombuffer(p["ids"], "<u4").tolist()
            assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], ids))
        full = 0
        for s in sequences.values():
            at = 0
            for offset, n, _ in sorted(s):
                assert offset == at
                at += n
            full += at == length
        total = sum(map(len, want))
        assert full >= total // length and sorted(sequences) == list(range(-(-total // length)))
        stream = [i for k in sorted(sequences) for _, _, ids in sorted(sequences[k]) for i in ids]
        by_doc, at = [], 0
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            if p["start"] == 0:
                by_doc.append(stream[at : at + p["doc_tokens"]])
            at += p["length"]
        assert sorted(by_doc, key=repr) == want


def test_packing_nothing(spark):
    assert packing.pack(data.documents(spark, [])).count() == 0


def test_runs_that_one_library_gives_up_on(spark, tokenizer):
    """A million blanks: the rank library raises, and the other one goes on."""
    runs = [" " * 1_000_000, "\n" * 1_000_000 + "x", "y" * 1_000_000, " " * 1_100_000 + "<|endoftext|>"]
    pieces = packing.pack(data.documents(spark, list(enumerate(runs)))).collect()
    got = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert got == {k: ids_of(tokenizer, t) + [1] for k, t in enumerate(runs)}


def test_the_libraries_agree(tokenizer):
    both = [libraries.BytePairs(libraries.vocabulary(), special) for special in (False, True)]
    assert both[0].fast is not None
    rng = random.Random(8)
    parts = ["a", " ", "  ", "\n", "'s", "1", "é", "\x85", "!", "the", "<|endoftext|>", "²", "🙂", "ing", "er", "un"]
    for text in ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)]:
        for b in both:
            assert b.encode(text) == b.slow.encode(text, add_special_tokens=False).ids
