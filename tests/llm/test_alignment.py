import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reelgraph.llm import alignment, bpe
from tests.llm import data


def models():
    a_path, b_path = alignment.vocabularies()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def groups_of(text, a_model, b_model):
    """(ids of both sides, groups) one token after the other; None where the bytes are not the text's."""
    byte = {c: b for b, c in enumerate(bpe.byte_letters())}
    a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
    a_raw = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
    b_raw = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    want = b" " + (text or "").encode()
    if not text or b"".join(a_raw) != want or b"".join(b_raw) != want:
        return None
    groups, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            left.append(a[i])
            x, i = x + len(a_raw[i]), i + 1
        else:
            right.append(b[j])
            y, j = y + len(b_raw[j]), j + 1
        if x == y and left and right:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups


def expected(rows):
    both = models()
    docs = [groups_of(t, *both) for _, t in rows]
    counts, best = Counter(), defaultdict(int)
    for d in docs:
        counts.update({(p, q) for g in (d[2] if d else []) for p in g[0] for q in g[1]})
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for (doc, _), d in zip(rows, docs, strict=True):
        a, b, groups = d or ([], [], [])
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if d else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=repr), counts, best


ODD = [(100, "a▁b"), (101, "<s>x</s><unk><0x41><|endoftext|>"), (102, "\x00\n \n\t  "), (103, " "), (104, "日本語テキスト" * 40), (105, "zqxj" * 900), (106, "🙂" * 300)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("links, large, hash_bytes, group", [(1 << 20, 4096, 64 << 20, 1 << 16), (50, 8, 2000, 100)])
def test_odd_documents(spark, monkeypatch, links, large, hash_bytes, group):
    """Also with small parts, when functions are read from the shared folder and counts come in several vectors."""
    for name, value in (("LINKS", links), ("LARGE", large), ("HELD", links)):
        monkeypatch.setattr(alignment, name, value)
    rows = data.texts() + ODD
    made = alignment.Alignment(data.documents(spark, rows), hash_bytes=hash_bytes, group=group)
    want, counts, best = expected(rows)
    assert rows_of(made.documents()) == want
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in made.counts().collect()} == counts
    assert {tuple(r) for r in made.best().collect()} == {(p, q, n) for (p, q), n in counts.items() if n == best[p]}


def test_small_table(spark):
    assert rows_of(alignment.align(data.table(spark, "documents"))) == expected(data.pairs(spark))[0]


def test_segments_are_encoded_as_in_their_texts(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 40)
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x85", "\u3000", "1", "é", "<s>", "<0x41>", "▁", "ing", "!", "日", "🙂", "\x00", "'s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    encoder, (a_model, b_model) = alignment.Encoder(alignment.vocabularies()), models()
    assert encoder.both[1].parts
    for k in range(0, len(texts), 50):
        found = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in encoder.encode(texts[k : k + 50])]
        for text, a, b in zip(texts[k : k + 50], *found, strict=True):
            assert (a.tolist(), b.tolist()) == (groups_of(text, a_model, b_model) or ([], []))[:2]


def test_nothing(spark):
    assert alignment.align(data.documents(spark, [])).count() == 0
    assert rows_of(alignment.align(data.documents(spark, [(1, None), (1, ""), (None, "▁")]))) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50000])
def test_a_perfect_hash_is_minimal_and_knows_its_keys(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    sizes, bits = alignment.perfect_hash(keys)
    row = {"part": 0, "n": n, "sizes": sizes, "bits": bits.tobytes(), "keys": b""}
    import pyarrow as pa

    numbers = alignment.Hashes(pa.Table.from_pylist([row]), 1).numbers(keys)
    assert sorted(numbers.tolist()) == list(range(n))
    row["keys"] = keys[np.argsort(numbers)].tobytes()
    hashes = alignment.Hashes(pa.Table.from_pylist([row]), 1)
    assert (hashes.find(keys) == numbers).all()
    others = np.setdiff1d(np.arange(2000, dtype=np.int64), keys)
    assert (hashes.find(others) == -1).all()
