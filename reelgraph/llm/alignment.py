"""Alignment of two tokenizers' tokens by byte offsets, with counts under a minimal perfect hash of the distinct pairs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import arrow_batches, saved, slices, spread
from reelgraph.llm.libraries import byte_pairs
from reelgraph.operators.kernels import parts_of, read_part

# White space in the sense of Unicode, and the sign that sentencepiece writes for a blank.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANK = chr(0x2581)
#: Where blanks stand between a sign that is no white space and one that is no blank; the same more quickly for texts
#: in which blanks stand after no other white space and not at the end.
SEGMENTS, OTHERS, PLAIN = re.compile(f"(?<=[^{SPACE}])(?= +[^ ])"), re.compile(f"[{SPACE.replace(' ', '')}] | $"), re.compile(" +[^ ]+")

KNOWN, KNOWN_BYTES = 1 << 19, 16 << 20  # different segments, and their letters, that a task remembers before it forgets all
ROWS = 1000  # documents that a Python step gets at once
TEXT_BYTES = 1 << 20  # text, or ids of one tokenizer, that a task works on at once
BITS = 20  # of an id, so a pair has 40 bits and a document's number within a chunk has room beside it
LINKS = 1 << 20  # links of a chunk that are looked at at once
LARGE = 4096  # a group of more links is taken by its different ids
HELD = 1 << 20  # counted pairs that a task holds before it sends them
GROUP = 1 << 16  # pairs under one hash function, and so numbers in one count vector
GAMMA = 2  # places for each pair on a level of a hash function
FAN = 16  # count vectors that are summed at once
HASH_BYTES = 64 << 20  # functions, keys and counts up to this size are sent to every task; larger ones are read by parts

COUNTED = "part int, n int, sizes array<int>, bits binary, keys binary, counts binary"
FUNCTION = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- tokens


class Tokens:
    """Bytes of the tokens of a vocabulary, by id."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.starts, self.sizes, ids)].tobytes()


class ByteLevel:
    """The first tokenizer: byte-level BPE; special tokens are plain text."""

    def __init__(self, path: str):
        self.model = byte_pairs(path, False)
        self.tokens = Tokens([self.model.raw.get(i, b"") for i in range(max(self.model.raw) + 1)])

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of segments, each of which starts with a blank.

        Those that end with a sign that is no white space are encoded in one text, since no token goes from one to the next.
        """
        alone = [k for k, s in enumerate(segments) if s[-1] in SPACE]
        joined = [s for s in segments if s[-1] not in SPACE] if alone else segments
        together = np.array(self.model.encode("".join(joined)), np.int64)
        ends = np.cumsum(np.fromiter((len(s.encode("utf-8", "surrogatepass")) for s in joined), np.int64, len(joined)))
        upto = np.searchsorted(np.cumsum(self.tokens.sizes[together]), ends) + 1
        rest = [self.model.encode(segments[k]) for k in alone]
        sizes, starts = (np.zeros(len(segments), np.int64) for _ in range(2))
        most = np.ones(len(segments), bool)
        most[alone] = False
        sizes[most] = np.diff(upto, prepend=0)
        sizes[alone] = [len(r) for r in rest]
        starts[most] = upto - sizes[most]
        starts[alone] = len(together) + np.cumsum(sizes[alone]) - sizes[alone]
        return np.concatenate([together, np.fromiter(chain.from_iterable(rest), np.int64)]), starts, sizes


class Pieces:
    """The second tokenizer: sentencepiece, which sets a blank before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)

        def raw(i: int) -> bytes:
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                return bytes([int(piece[3:5], 16)])
            return b"" if m.is_control(i) or m.is_unknown(i) else piece.replace(BLANK, " ").encode()

        self.tokens = Tokens([raw(i) for i in range(m.vocab_size())])
        #: No piece has a blank after another sign, so none lies across the start of a run of blanks.
        self.parts = not any(re.search(f"[^{BLANK}]{BLANK}", m.id_to_piece(i)) for i in range(m.vocab_size()))

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.model.encode([s[1:] for s in segments], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes


@lru_cache(2)
def tokenizers_of(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    both = ByteLevel(a_path), Pieces(b_path)
    if max(len(t.tokens.sizes) for t in both) > 1 << BITS:
        raise ValueError(f"a vocabulary of more than {1 << BITS} ids")
    return both


def _kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def segments(sentence: str) -> list[str]:
    return SEGMENTS.split(sentence) if OTHERS.search(sentence) else PLAIN.findall(sentence)


class Encoder:
    """Both tokenizers' ids of texts, by segments: a run of blanks and what follows it, up to the next one.

    Neither tokenizer has a token across the start of a blank run that other signs stand before and after, so a segment
    has the same tokens in every text. Different ones are encoded once and remembered, up to a bound. A vocabulary with
    pieces across such places is given whole texts.
    """

    def __init__(self, paths: tuple[str, str]):
        self.both = tokenizers_of(*paths)
        self.cut = segments if self.both[1].parts else lambda sentence: [sentence]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.letters = 0
        self.fits = np.empty(0, bool)
        self.ids, self.starts, self.sizes = ([np.empty(0, np.int64)] * 2 for _ in range(3))

    def _learn(self, segments: list[str]) -> None:
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        self.letters += sum(map(len, raw))
        for k, tokenizer in enumerate(self.both):
            ids, starts, sizes = tokenizer.encode(segments)
            self.starts[k] = np.concatenate([self.starts[k], len(self.ids[k]) + starts])
            self.sizes[k] = np.concatenate([self.sizes[k], sizes])
            self.ids[k] = np.concatenate([self.ids[k], ids])
        # The first tokenizer gives all bytes back.
        ends = np.concatenate([[0], np.cumsum(tokenizer.tokens.sizes[ids])])
        whole, low, high = tokenizer.tokens.joined(ids), ends[starts].tolist(), ends[starts + sizes].tolist()
        self.fits = np.concatenate([self.fits, np.array([whole[s:e] == r for s, e, r in zip(low, high, raw, strict=True)], bool)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By tokenizer the ids of all texts and how many each has; a text whose bytes would not come back has none."""
        if len(self.known) > KNOWN or self.letters > KNOWN_BYTES:
            self._forget()
        number, had = self.known.__getitem__, len(self.known)
        used = [np.array(list(map(number, self.cut(" " + t))) if t else [], np.int64) for t in texts]
        self._learn(list(islice(self.known, had, None)))
        used = [x if self.fits[x].all() else x[:0] for x in used]
        numbers = np.concatenate([np.empty(0, np.int64), *used])
        upto = np.cumsum([0, *map(len, used)])
        out = []
        for ids, starts, sizes in zip(self.ids, self.starts, self.sizes, strict=True):
            ends = np.concatenate([[0], np.cumsum(sizes[numbers])])[upto]
            out.append((ids[spread(starts, sizes, numbers)], np.diff(ends)))
        return out


def _kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, a, b): both tokenizers' ids of each text (doc_id, text), none where the tokens' bytes are not the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(paths)
        for batch in slices(batches, "text", TEXT_BYTES):
            columns = []
            for tokenizer, (ids, counts) in zip(encoder.both, encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                kind = _kind(len(tokenizer.tokens.sizes))
                raw, ends = ids.astype(kind).tobytes(), np.cumsum(counts) * int(kind[2])
                sizes = counts * int(kind[2])
                columns.append(pa.array([raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()))
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, a binary, b binary")


# ---------------------------------------------------------------- alignment


class Aligned:
    """The tokens of a chunk of documents, in groups between the places where a token of each side ends.

    All documents of the chunk lie one after the other. The tokens of both sides have the same bytes, so a document's
    end is an end on both sides, and no group crosses it.
    """

    def __init__(self, a: list[bytes], b: list[bytes], tokens: tuple[Tokens, Tokens]):
        self.n = []
        self.ids = []
        for column, t in zip((a, b), tokens, strict=True):
            kind = _kind(len(t.sizes))
            self.n.append(np.array([len(x) // int(kind[2]) for x in column], np.int64))
            self.ids.append(np.frombuffer(b"".join(column), kind).astype(np.int64))
        a_ends, b_ends = (np.cumsum(t.sizes[i]) for t, i in zip(tokens, self.ids, strict=True))
        at = np.searchsorted(b_ends, a_ends)
        at_b = np.minimum(at, max(len(b_ends) - 1, 0))
        self.last = [b_ends[at_b] == a_ends if len(b_ends) else np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)]
        self.last[1][at_b[self.last[0]]] = True
        self.group = [np.cumsum(last) - last for last in self.last]  # of each token
        self.groups = int(self.last[0].sum())
        self.size = [np.bincount(g, minlength=self.groups) for g in self.group]
        self.first = [np.cumsum(s) - s for s in self.size]
        docs = np.repeat(np.arange(len(a)), self.n[0])
        self.doc = docs[self.first[0]] if self.groups else np.empty(0, np.int64)  # of each group
        self.links = self.size[0] * self.size[1]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each document."""
        n = len(self.n[0])
        links = np.zeros(n, np.int64)
        np.add.at(links, self.doc, self.links)
        return np.bincount(self.doc, minlength=n), links

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, links): the links of all groups, a bounded number at a time; a pair is a << BITS | b."""
        (a, b), (size_a, size_b), (first_a, first_b) = self.ids, self.size, self.first
        plain = self.links <= LARGE
        token = np.flatnonzero(plain[self.group[0]])
        group = self.group[0][token]
        ends = np.cumsum(size_b[group])
        start = 0
        while start < len(token):
            base = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + LINKS, "right")))
            t, g = token[start:end], group[start:end]
            left = np.repeat(a[t], size_b[g])
            yield np.repeat(self.doc[g], size_b[g]), left << BITS | b[spread(first_b, size_b, g)], np.ones(len(left), np.int64)
            start = end
        for g in np.flatnonzero(~plain).tolist():
            left, n_left = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            right, n_right = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            step = max(1, LINKS // len(right))
            for k in range(0, len(left), step):
                key = (left[k : k + step, None] << BITS | right[None, :]).ravel()
                yield np.full(len(key), self.doc[g]), key, np.outer(n_left[k : k + step], n_right).ravel()

    def texts(self, numbers: Numbers) -> list[str]:
        """The digest of each document's groups in writing, empty for one without tokens."""
        n_docs = len(self.n[0])
        total = self.n[0] + self.n[1]
        # Where a token stands among all of both sides: after its own side's and the other's of the groups before.
        place_a = np.arange(len(self.ids[0])) + self.first[1][self.group[0]] if self.groups else np.empty(0, np.int64)
        place_b = np.arange(len(self.ids[1])) + (self.first[0] + self.size[0])[self.group[1]] if self.groups else np.empty(0, np.int64)
        written = np.empty(len(place_a) + len(place_b), np.int64)
        written[place_a] = numbers.entry(self.ids[0], np.where(self.last[0], numbers.BAR, numbers.COMMA))
        sign = np.where(self.last[1], numbers.SEMICOLON, numbers.COMMA)
        sign[np.cumsum(self.n[1])[self.n[1] > 0] - 1] = numbers.END
        written[place_b] = numbers.entry(self.ids[1], sign)
        ends = np.cumsum(total)
        hashes = [hashlib.sha256() for _ in range(n_docs)]
        for start in range(0, len(written), LINKS):
            part = written[start : start + LINKS]
            raw = memoryview(numbers.bytes[spread(numbers.starts, numbers.sizes, part)])
            upto = np.concatenate([[0], np.cumsum(numbers.sizes[part])])
            for d in range(int(np.searchsorted(ends, start, "right")), n_docs):
                low = max(0, int(ends[d] - total[d]) - start)
                if low >= len(part):
                    break
                hashes[d].update(raw[int(upto[low]) : int(upto[min(len(part), int(ends[d]) - start)])])
        return [h.hexdigest() if n else "" for h, n in zip(hashes, total.tolist(), strict=True)]


class Numbers:
    """Ids as decimal numbers, each with the sign that follows it."""

    COMMA, BAR, SEMICOLON, END = range(4)

    def __init__(self, most: int):
        parts = [str(i).encode() + sign for sign in (b",", b"|", b";", b"") for i in range(most)]
        self.most = most
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def entry(self, ids: np.ndarray, sign: np.ndarray) -> np.ndarray:
        return sign * self.most + ids


@lru_cache(1)
def _numbers(most: int) -> Numbers:
    return Numbers(most)


def _chunks(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    tokens = tuple(t.tokens for t in tokenizers_of(*paths))
    for batch in slices(batches, "a", TEXT_BYTES):
        yield batch, Aligned(batch.column("a").to_pylist(), batch.column("b").to_pylist(), tokens)


def _together(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    all_keys, all_counts = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.diff(all_keys, prepend=-1))
    return all_keys[first], np.add.reduceat(all_counts[order], first) if len(first) else all_counts


def _different(parts: list[np.ndarray]) -> np.ndarray:
    """The different ones among some arrays of numbers from 0 on, in order."""
    if len(parts) == 1:
        every = np.sort(parts[0])
    else:
        every = np.concatenate([np.empty(0, np.int64), *parts])
        every.sort()
    return every[np.diff(every, prepend=-1) != 0]


def _documents(aligned: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a chunk and how many of its documents hold each."""
    both = _different([_different([doc << 2 * BITS | key]) for doc, key, _ in aligned.pairs()])
    keys = both & (1 << 2 * BITS) - 1
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def _counted(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different pairs of a task and their documents, whenever ``HELD`` have come together and at the end."""
    keys, counts, n = [], [], 0
    for _, aligned in _chunks(batches, paths):
        key, count = _documents(aligned)
        keys.append(key)
        counts.append(count)
        n += len(key)
        if n > HELD:
            key, count = _together(keys, counts)
            keys, counts, n = [key], [count], len(key)
            if n > HELD // 2:
                yield key, count
                keys, counts, n = [], [], 0
    if n:
        yield _together(keys, counts)


# ---------------------------------------------------------------- minimal perfect hashing


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each key; a bijection for each seed, so different keys part on some level."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys, -1) % np.uint64(parts)).astype(np.int32)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a function that numbers the different ``keys`` from 0 without a gap.

    On each level a key that is alone in its place sets the place's bit, the others go on to the next level (Limasset
    and others, 2017). A key's number is how many bits are set before its own.
    """
    sizes, bits = [], [np.empty(0, np.uint64)]
    while len(keys):
        size = 64 * -(-GAMMA * len(keys) // 64)
        at = (mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        n = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(np.packbits(n == 1, bitorder="little").view("<u8"))
        keys = keys[n[at] > 1]
    return sizes, np.concatenate(bits)


class Hashes:
    """The functions of some parts, with the keys and counts that they number, looked up for whole arrays of pairs."""

    def __init__(self, table: pa.Table | pa.RecordBatch, parts: int):
        rows = table.to_pylist()
        self.parts = parts
        self.row = np.full(parts, -1)
        self.row[[r["part"] for r in rows]] = np.arange(len(rows))
        levels = max([len(r["sizes"]) for r in rows], default=0)
        self.size = np.zeros((len(rows), levels), np.int64)
        for k, r in enumerate(rows):
            self.size[k, : len(r["sizes"])] = r["sizes"]
        self.start = (np.cumsum(self.size) - self.size.ravel()).reshape(self.size.shape)
        self.words = np.frombuffer(b"".join(r["bits"] for r in rows), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.first = np.cumsum([0, *(r["n"] for r in rows)])
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), "<i8")
        self.counts = np.frombuffer(b"".join(r.get("counts") or b"" for r in rows), "<i8")

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one of another part; keys that were not there when it was made may get any."""
        out = np.full(len(keys), -1)
        row = self.row[part_of(keys, self.parts)]
        left = np.flatnonzero(row >= 0)
        for level in range(self.size.shape[1]):
            size = self.size[row[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.start[row[left], level] + (mix(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, at = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> at & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << at) - np.uint64(1)))
            out[left[hit]] = (self.before[bit >> 6] + below)[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key that is really the key of that number, else -1."""
        out = self.numbers(keys)
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def _functions(keys: DataFrame, parts: int) -> DataFrame:
    """(part, n, sizes, bits, keys): a function for each part of the different pairs (key)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key")
            yield pa.record_batch([pa.array(part_of(key.to_numpy(), parts)), key], names=["part", "key"])

    def make(table: pa.Table) -> pa.Table:
        key, part = table.column("key").to_numpy(), table.column("part")[0].as_py()
        sizes, bits = perfect_hash(key)
        made = {"part": [part], "n": [len(key)], "sizes": [sizes], "bits": [bits.tobytes()], "keys": [b""]}
        ordered = np.empty(len(key), "<i8")
        ordered[Hashes(pa.table(made), parts).numbers(key)] = key
        made["keys"] = [ordered.tobytes()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(made.items(), FUNCTION, strict=True)})

    placed = keys.mapInArrow(place, "part int, key long")
    return placed.groupBy("part").applyInArrow(make, COUNTED.removesuffix(", counts binary"))


class Lookup:
    """Functions, keys and counts for a task: those sent to it, or part after part from the shared folder."""

    def __init__(self, parts: int, sent=None, folder: str | None = None, folders: int = 0):
        self.parts, self.sent, self.folder, self.folders, self.made = parts, sent, folder, folders, None

    def tables(self) -> Iterator[Hashes]:
        if self.sent is not None:
            if self.made is None:  # put together once in a task
                self.made = Hashes(pa.ipc.open_stream(self.sent.value).read_all(), self.parts)
            yield self.made
            return
        for k in range(self.folders):
            table = read_part(self.folder, k, [c.split()[0] for c in COUNTED.split(", ")])
            if table is not None:
                yield Hashes(table, self.parts)


def _lookup(table: DataFrame, parts: int, most: int) -> Lookup:
    """How tasks get at a table of functions: all of it where its measured size allows, else by parts."""
    size = table.agg(F.sum(sum(F.length(c) for c in table.columns if c in ("bits", "keys", "counts")))).first()[0] or 0
    if size <= most:
        sink = pa.BufferOutputStream()
        whole = table.toArrow()
        with pa.ipc.new_stream(sink, whole.schema) as stream:
            stream.write_table(whole)
        return Lookup(parts, table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()))
    folders = math.ceil(size / most)
    with arrow_batches(table.sparkSession, 16):
        return Lookup(parts, None, parts_of(table, folders, "part"), folders)


# ---------------------------------------------------------------- counts


def _vectors(ids: DataFrame, lookup: Lookup, paths: tuple[str, str]) -> DataFrame:
    """(part, piece, counts): for what a task has counted, a dense vector for each part that it has pairs of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (keys, counts) in enumerate(_counted(batches, paths)):
            piece = TaskContext.get().partitionId() + 7919 * k
            for hashes in lookup.tables():
                number = hashes.find(keys)
                row = np.searchsorted(hashes.first, number, "right") - 1
                for r in np.unique(row[number >= 0]).tolist():
                    own = row == r
                    vector = np.zeros(int(hashes.first[r + 1] - hashes.first[r]), "<i8")
                    vector[number[own] - hashes.first[r]] = counts[own]
                    part = int(np.flatnonzero(hashes.row == r)[0])
                    yield pa.record_batch(
                        [pa.array([part], pa.int32()), pa.array([piece], pa.int64()), pa.array([vector.tobytes()], pa.binary())],
                        names=["part", "piece", "counts"],
                    )

    return ids.mapInArrow(run, "part int, piece long, counts binary")


def _summed(vectors: DataFrame) -> DataFrame:
    """(part, counts): the vectors of each part added up in a tree, ``FAN`` or so at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("counts"):
            own = np.frombuffer(raw.as_buffer(), "<i8")
            total = own.copy() if total is None else total + own
        first = table.slice(0, 1)
        return pa.table({"part": first["part"], "piece": first["piece"], "counts": pa.array([total.tobytes()], pa.binary())})

    pieces = (vectors.agg(F.max("piece")).first()[0] or 0) + 1
    while pieces > 1:
        pieces = math.ceil(pieces / FAN)
        vectors = vectors.withColumn("piece", F.pmod("piece", F.lit(pieces)))
        vectors = vectors.groupBy("part", "piece").applyInArrow(add, "part int, piece long, counts binary")
    return vectors.select("part", "counts")


class Alignment:
    """Tokens of all documents, and how many documents hold each pair of ids linked.

    ``ids`` (doc_id, a, b) and ``counted`` (part, n, sizes, bits, keys, counts) lie in the shared folder. The counts are
    made in two looks at the stored ids: the first finds the different pairs, from which a minimal perfect hash function is made for each
    part of them; the second counts into dense vectors under these functions, which are added up in a tree.
    """

    def __init__(
        self, docs: DataFrame, paths: tuple[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
        hash_bytes: int = HASH_BYTES, group: int = GROUP,
    ):
        self.paths, self.spark, self.hash_bytes = paths or vocabularies(), docs.sparkSession, hash_bytes
        paths = self.paths
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        with arrow_batches(self.spark, ROWS):
            self.ids = saved(tokenized(docs, paths), "aligned-ids", compression="zstd")

            def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for keys, _ in _counted(batches, paths):
                    yield pa.record_batch([pa.array(keys)], names=["key"])

            keys = saved(self.ids.mapInArrow(pairs, "key long").distinct(), "aligned-pairs")
        n = keys.count()
        self.parts = max(1, math.ceil(n / group))
        made = saved(_functions(keys, self.parts), "aligned-functions")
        with arrow_batches(self.spark, ROWS):
            known = _lookup(made.withColumn("counts", F.lit(b"")), self.parts, hash_bytes)
            vectors = saved(_vectors(self.ids, known, paths), "aligned-vectors")
        with arrow_batches(self.spark, 64):
            self.counted = saved(made.join(_summed(vectors), "part"), "aligned-counts")

    def counts(self) -> DataFrame:
        """(a_id, b_id, n_docs) of every pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    key = np.frombuffer(keys, "<i8")
                    columns = [key >> BITS, key & (1 << BITS) - 1, np.frombuffer(counts, "<i8")]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["a_id", "b_id", "n_docs"])

        return self.counted.select("keys", "counts").mapInArrow(run, "a_id long, b_id long, n_docs long")

    def best(self) -> DataFrame:
        """(a_id, b_id, n_docs) of the pairs with the most documents of their first id, ties included."""
        counts = self.counts()
        most = counts.groupBy("a_id").agg(F.max("n_docs").alias("n_docs"))
        return counts.join(most, ["a_id", "n_docs"], "left_semi").select("a_id", "b_id", "n_docs")

    def documents(self) -> DataFrame:
        """Per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), aligned again."""
        paths, spark = self.paths, self.spark
        with arrow_batches(spark, 64):
            known = _lookup(self.counted, self.parts, self.hash_bytes)
            # A number for each id of the first vocabulary, whatever the documents.
            most = self.counts().groupBy("a_id").agg(F.max("n_docs").alias("n")).toArrow()
        best = np.zeros(int(max(most["a_id"].to_pylist(), default=0)) + 1, np.int64)
        best[most["a_id"].to_numpy()] = most["n"].to_numpy()
        best = spark.sparkContext.broadcast(best)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = tokenizers_of(*paths)
            numbers = _numbers(max(len(t.tokens.sizes) for t in both))
            for batch, aligned in _chunks(batches, paths):
                n_groups, n_links = aligned.counts()
                keys = _different([_different([key]) for _, key, _ in aligned.pairs()])
                counts = np.zeros(len(keys), np.int64)
                for hashes in known.tables():
                    number = hashes.find(keys)
                    counts[number >= 0] = hashes.counts[number[number >= 0]]
                n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for doc, key, links in aligned.pairs():
                    count = counts[np.searchsorted(keys, key)]
                    np.add.at(count_sum, doc, links * count)
                    np.add.at(n_best, doc, links * (count == best.value[key >> BITS]))
                columns = [*aligned.n, n_groups, n_links, n_best, count_sum]
                yield pa.record_batch(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(aligned.texts(numbers), pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return self.ids.mapInArrow(run, schema)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: how its tokens under two vocabularies lie to each other, and what that says corpus-wide.

    Offsets at which a token of both sides ends cut a document into groups; the tokens of a group are linked with each
    other. A pair's count is the number of documents (rows) that hold it linked. ``n_best`` are the links whose count is
    the highest of their first id, ties included, ``count_sum`` adds the counts of all links.

    A null or empty text, and one whose tokens do not give its bytes back (it holds U+2581), has no tokens: zeros and
    an empty digest. Long texts and large groups are taken whole; a group's links are counted by different ids where
    they are many. A null id is carried along, repeated rows count and are returned each, an empty table gives an empty
    result. Other columns are ignored, whatever their names. A count_sum beyond a long is not supported.
    """
    return Alignment(docs, paths, id_col=id_col, text_col=text_col, **options).documents()
