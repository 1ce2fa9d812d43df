"""Byte-level BPE encoding and decoding with an index from pairs to all their positions in a chunk of a partition."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import slices, spread

CHUNK_BYTES = 4 << 20  # text whose words share one index; a chunk takes about sixty times that in memory

# White space in the sense of Unicode, and the word pattern of this tokenizer family.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: No word spans a blank that something other than white space follows, so texts may be cut before such blanks.
CUT = regex.compile(rf" (?=[^{SPACE}])")
NONE = np.int64(1 << 40)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter by which the vocabulary file writes each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.base = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        born = {c: -1 for c in letters}
        for rank, (a, b) in enumerate(pairs):
            # Then a merge never makes a pair of lower rank, and one ascending pass over the ranks is enough.
            if max(born[a], born[b]) >= rank:
                raise ValueError("a merge comes before one of its parts")
            born.setdefault(a + b, rank)
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        text = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [text.get(i, b"") for i in range(max(text) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NONE where no merge joins them."""
        if not len(a):
            return np.empty(0, np.int64)
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


@lru_cache(2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """The words of a chunk as one linked list of ids, and for each rank the positions where its pair may stand."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        self.vocab = vocab
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(sizes)
        n = int(self.ends[-1]) if len(words) else 0
        self.ids = vocab.base.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.next[self.ends - 1] = -1
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        self.prev[self.ends - sizes] = -1
        self.alive = np.ones(n, bool)
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(self.next >= 0).astype(np.int32)
        self.add(at, self.vocab.rank(self.ids[at], self.ids[at + 1]))

    def add(self, at: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks < NONE
        at, ranks = at[known], ranks[known]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(at, cuts), strict=False):
            if rank not in self.positions:
                self.positions[rank] = []
                heapq.heappush(self.active, rank)
            self.positions[rank].append(part)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply the active ranks in ascending order; the ids, and how many each word has."""
        while self.active:
            rank = heapq.heappop(self.active)
            self.merge(rank, self.positions.pop(rank))
        count = np.cumsum(self.alive)[self.ends - 1] if len(self.ends) else np.empty(0, np.int64)
        return self.ids[self.alive], np.diff(count, prepend=0)

    def merge(self, rank: int, parts: list[np.ndarray]) -> None:
        v, ids = self.vocab, self.ids
        a, b, made = v.left[rank], v.right[rank], v.made[rank]
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
        after = self.next[at]
        fits = self.alive[at] & (after >= 0) & (ids[at] == a) & (ids[after] == b)  # positions may be out of date
        at, after = at[fits], after[fits]
        if a == b and len(at) > 1:  # pairs of equal ids overlap: the leftmost wins
            taken, used = [], -1
            for p, q in zip(at.tolist(), after.tolist(), strict=True):
                if p != used:
                    taken.append(p)
                    used = q
            at = np.array(taken, np.int32)
            after = self.next[at]
        if not len(at):
            return
        ids[at] = made
        self.alive[after] = False
        then = self.next[after]
        self.next[at] = then
        more = then >= 0
        self.prev[then[more]] = at[more]
        before = self.prev[at]
        before = before[before >= 0]
        left = np.concatenate([before, at[more]])
        self.add(left, v.rank(ids[left], ids[self.next[left]]))


class Encoder:
    def __init__(self, path: str):
        self.vocab = load(path)
        self.word = regex.compile(WORD)
        special = self.vocab.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, and how many each text has."""
        first, later = defaultdict(), defaultdict()  # pieces at a start; pieces that a blank precedes, and special ones
        counter = iter(range(1 << 62)).__next__
        first.default_factory = later.default_factory = counter
        pieces = []
        for text in texts:
            own = []
            for k, part in enumerate(self.special.split(text) if self.special and text and any(s in text for s in self.vocab.special) else [text or ""]):
                if k % 2:
                    own.append(later[(part,)])
                elif part:
                    head, *rest = CUT.split(part)
                    own.append(first[head])
                    own += [later[p] for p in rest]
            pieces.append(np.array(own, np.int64))
        ids, sizes = self._pieces(first, later)
        used = np.concatenate([np.empty(0, np.int64), *pieces])
        flat = ids[spread(np.cumsum(sizes) - sizes, sizes, used)]
        ends = np.cumsum(sizes[used])
        upto = np.cumsum([len(p) for p in pieces])
        done = np.concatenate([[0], ends])[upto] if len(pieces) else np.empty(0, np.int64)
        return flat, np.diff(done, prepend=0)

    def _pieces(self, first: dict, later: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all different pieces in the order of their numbers, and how many each has."""
        words = defaultdict()
        words.default_factory = words.__len__
        numbered = sorted([(n, p, False) for p, n in first.items()] + [(n, p, True) for p, n in later.items()], key=lambda x: x[0])
        own, counts = [], []
        for _, p, blank in numbered:
            if isinstance(p, tuple):
                found = [p]
            else:
                found = self.word.findall(" " + p if blank else p)
            own += [words[w] for w in found]
            counts.append(len(found))
        plain = [(n, w.encode()) for w, n in words.items() if not isinstance(w, tuple)]
        ids, sizes = PairIndex(self.vocab, [w for _, w in plain]).merge_all()
        starts, lengths = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        numbers = np.array([n for n, _ in plain], np.int64)
        starts[numbers], lengths[numbers] = np.cumsum(sizes) - sizes, sizes
        extra = [(n, self.vocab.special[w[0]]) for w, n in words.items() if isinstance(w, tuple)]
        for k, (n, _) in enumerate(extra):
            starts[n] = len(ids) + k
        ids = np.concatenate([ids, np.array([i for _, i in extra], np.int64)])
        own = np.array(own, np.int64)
        of = np.concatenate([[0], np.cumsum(lengths[own])])
        ends = of[np.cumsum(counts)] if counts else np.empty(0, np.int64)
        return ids[spread(starts, lengths, own)], np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocab
        return v.bytes[spread(v.starts, v.sizes, ids.astype(np.int64))].tobytes().decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian uint32.

    Each task takes its texts in chunks of bounded size. The different words of a chunk form one list of ids; the index
    holds, for each merge that could apply, all positions of its pair. Ranks are applied in ascending order, each at all
    its positions, and the lists of the pairs that arise or vanish beside them follow. A special token in a text is one
    id. A null or empty text has no ids. A null id is carried along, repeated rows give repeated rows, an empty table
    gives none. Other columns are ignored, whatever their names.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, "text", CHUNK_BYTES):
            flat, counts = encoder.encode(batch.column("text").to_pylist())
            flat, ends = flat.astype("<u4"), np.cumsum(counts)
            ids = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``ids`` (doc_id, n_tokens, ids) with ``text``; bytes that are no UTF-8 become the replacement character."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, "ids", CHUNK_BYTES):
            texts = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    done = decoded(encoded(docs, path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
