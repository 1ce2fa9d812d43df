"""Byte-level BPE by merge ranks: a segment tree over the bytes of a match finds the leftmost pair of least rank."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import slices, spread

CHUNK_BYTES = 4 << 20  # text or ids that a task takes at once
MATCHES = 1 << 16  # matches of a text that are looked up at once
KNOWN, KNOWN_BYTES = 1 << 18, 16 << 20  # different matches, and their letters, that a task remembers before it forgets all
CELLS = 1 << 20  # leaves of the trees that are worked on side by side
ABREAST = 16  # fewer trees than this are walked one by one
NONE = np.int64(1 << 62)

#: The code points of white space in the sense of Unicode, which backslash-s means in the pattern.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def compiled(pattern: str):
    """The pattern with its classes of white space written out; the libraries differ in what they take for a blank."""
    inside = regex.sub(r"\[\^\\s", lambda _: "[^" + SPACE, pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Ranks:
    """A rank file: tokens by rank, which is their id, and the ranks of all pairs of tokens that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        lacking = [b for b in range(256) if bytes([b]) not in self.of]
        if lacking:
            raise ValueError(f"no token for the bytes {lacking}")
        self.single = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.of.items():
            for cut in range(1, len(token)):
                a, b = self.of.get(token[:cut]), self.of.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.tokens = {rank: token for token, rank in self.of.items()}
        parts = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, NONE where it makes none."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], NONE)


@lru_cache(2)
def load(path: str) -> Ranks:
    return Ranks(path)


class Forest:
    """Segment trees of many matches side by side; a leaf is a byte position and holds the rank of the pair that starts there.

    A node holds the least of its leaves as rank * width + position, so a root tells the leftmost pair of least rank. A
    merge changes the leaves of the merged pair, of the one it swallows and of its left neighbour, and the nodes above.
    """

    def __init__(self, ranks: Ranks, words: list[bytes], width: int):
        self.ranks, self.width, n = ranks, width, len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width)
        self.live = place < sizes[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[self.live] = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        after[np.arange(n), sizes - 1] = width  # none
        self.next, self.prev = after.ravel(), np.broadcast_to(place - 1, (n, width)).copy().ravel()
        tree = np.full((n, 2 * width), NONE)
        if width > 1:
            row, at = np.nonzero(self.live[:, 1:])
            tree[row, width + at] = self._leaf(ranks.rank(ids[row, at], ids[row, at + 1]), at)
        half = width // 2
        while half:
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
            half //= 2
        self.ids, self.alive, self.tree = ids.ravel(), self.live.ravel(), tree.ravel()

    def _leaf(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, np.minimum(rank, NONE // self.width - 1) * self.width + at, NONE)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair has a rank; the ids of all matches, and how many each has."""
        width, tree = self.width, self.tree
        rows = np.arange(len(self.live))
        while True:
            best = tree[rows * 2 * width + 1]
            on = best < NONE
            rows, best = rows[on], best[on]
            if not len(rows):
                break
            self._merge(rows, best % width, best // width)
        alive = self.alive.reshape(self.live.shape)
        return self.ids[self.alive], alive.sum(1)

    def _merge(self, rows: np.ndarray, at: np.ndarray, made: np.ndarray) -> None:
        base = rows * self.width
        second = self.next[base + at]
        then = self.next[base + second]
        self.ids[base + at] = made
        self.alive[base + second] = False
        self.next[base + at] = then
        more = then < self.width
        self.prev[(base + then)[more]] = at[more]
        right = np.full(len(rows), NONE)
        right[more] = self._leaf(self.ranks.rank(made[more], self.ids[(base + then)[more]]), at[more])
        before = self.prev[base + at]
        some = before >= 0
        left = self._leaf(self.ranks.rank(self.ids[(base + before)[some]], made[some]), before[some])
        self._update(
            np.concatenate([rows, rows, rows[some]]), np.concatenate([at, second, before[some]]),
            np.concatenate([right, np.full(len(rows), NONE), left]),
        )

    def _update(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        base, node, tree = rows * 2 * self.width, self.width + at, self.tree
        tree[base + node] = values
        for _ in range(self.width.bit_length() - 1):
            node >>= 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])


def merged_alone(ranks: Ranks, word: bytes) -> list[int]:
    """The ids of one match by a segment tree in lists, for long matches that have no others beside them."""
    n = len(word)
    width = 1 << max(0, n - 1).bit_length()
    of, tokens = ranks.of, [ranks.tokens[i] for i in ranks.single[np.frombuffer(word, np.uint8)].tolist()]
    none = (1 << 62) * width
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = of.get(tokens[i] + tokens[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(at: int, value: int) -> None:
        at += width
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                return  # nothing changes further up
            tree[at] = least

    while tree[1] < none:
        at = tree[1] % width
        second = after[at]
        then = after[second]
        tokens[at] += tokens[second]
        tokens[second] = None
        after[at] = then
        update(second, none)
        rank = None
        if then < n:
            before[then] = at
            rank = of.get(tokens[at] + tokens[then])
        update(at, none if rank is None else rank * width + at)
        left = before[at]
        if left >= 0:
            rank = of.get(tokens[left] + tokens[at])
            update(left, none if rank is None else rank * width + left)
    return [of[t] for t in tokens if t is not None]


def merged(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all matches one after the other, and how many each has; none of the matches is empty.

    A match that is a token is its id. The rest are sorted into trees of like width.
    """
    found: list[np.ndarray | None] = [None] * len(words)
    by_width = defaultdict(list)
    for k, word in enumerate(words):
        own = ranks.of.get(word)
        if own is None:
            by_width[1 << (len(word) - 1).bit_length()].append(k)
        else:
            found[k] = np.array([own], np.int64)
    for width, places in by_width.items():
        step = max(1, CELLS // width)
        for start in range(0, len(places), step):
            part = places[start : start + step]
            if len(part) < ABREAST:
                for k in part:
                    found[k] = np.array(merged_alone(ranks, words[k]), np.int64)
            else:
                ids, counts = Forest(ranks, [words[k] for k in part], width).merge_all()
                for k, own in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    found[k] = own
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.concatenate([np.empty(0, np.int64), *found]), counts


class Encoder:
    """Texts to ids and back; different matches are merged once and remembered, up to a bound, for later texts."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load(path)
        self.matches = compiled(pattern).finditer
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.letters = 0
        self.ids, self.starts, self.sizes = (np.empty(0, np.int64) for _ in range(3))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if len(self.known) > KNOWN or self.letters > KNOWN_BYTES:
            self._forget()
        number, had = self.known.__getitem__, len(self.known)
        used, ends = [np.empty(0, np.int64)], []
        total = 0
        for text in texts:
            found = self.matches(text or "")
            while part := [number(m.group()) for m in islice(found, MATCHES)]:
                used.append(np.array(part, np.int64))
                total += len(part)
            ends.append(total)
        fresh = [w.encode("utf-8", "surrogatepass") for w in islice(self.known, had, None)]
        self.letters += sum(map(len, fresh))
        ids, sizes = merged(self.ranks, fresh)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        numbers = np.concatenate(used)
        upto = np.concatenate([[0], np.cumsum(self.sizes[numbers])])[np.array(ends, np.int64)] if ends else np.empty(0, np.int64)
        return self.ids[spread(self.starts, self.sizes, numbers)], np.diff(upto, prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        r = self.ranks
        return r.bytes[spread(r.starts, r.sizes, ids.astype(np.int64))].tobytes()


def encoded(
    docs: DataFrame, path: str | None = None, *, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian uint32, by the ranks in ``path`` and without special tokens.

    A text is cut by the pattern and each match is merged by itself, the leftmost pair of least rank first. A null or
    empty text has no ids; one that holds the text of a special token is like any other. Long texts and long matches are
    encoded whole. A null id is carried along, repeated rows give repeated rows, an empty table gives none. Other
    columns are ignored, whatever their names.
    """
    path, pattern = path or vocabulary(), pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
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
    """``ids`` (doc_id, n_tokens, ids) with ``bytes``, those of the tokens one after the other."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, "")
        for batch in slices(batches, "ids", CHUNK_BYTES):
            raw = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("bytes", pa.array(raw, pa.binary()))

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids binary, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    done = decoded(encoded(docs, path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
