"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import slices

HIDDEN = 8  # units in each direction
SPAN = 256  # bytes that one pass runs over; a text is so many passes side by side, all of it is labelled
TRAIN_SPAN = 64
TRAIN_DOCS = 4000  # documents the network is fitted on, at most; chosen by a hash of the id
TRAIN_BYTES = 2048  # bytes of each of these that may be seen, from all over the text
STEPS, BATCH, RATE, SEED = 240, 256, 0.03, 11
CHUNK_BYTES = 4 << 20
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    w: dict[str, np.ndarray]  # for each direction d: x{d} (257, 3h), u{d} (h, 3h); o (2h, k), c (k)


def _start(langs: list[str], h: int = HIDDEN) -> Model:
    rng = np.random.default_rng(SEED)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * h)).astype("f4")  # byte 256 stands for padding
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype("f4")
    w["o"] = rng.normal(0, 0.3, (2 * h, len(langs))).astype("f4")
    w["c"] = np.zeros(len(langs), "f4")
    return Model(langs, w)


def _sweep(w: dict, d: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction at each position (time, row, unit); codes are (time, row).

    Update gate z, reset gate r and candidate n; the sigmoid is written as a tanh, so one call does both gates.
    """
    x, u = w[f"x{d}"], w[f"u{d}"]
    h = u.shape[0]
    time, rows = codes.shape
    states = np.empty((time, rows, h), "f4")
    s = np.zeros((rows, h), "f4")
    tape = []
    for t in range(time) if d == "f" else range(time - 1, -1, -1):
        a = x[codes[t]]
        g = s @ u
        zr = np.tanh(0.5 * (a[:, : 2 * h] + g[:, : 2 * h]))
        zr += 1
        zr *= 0.5
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
        if keep:
            tape.append((t, s, z, r, n, g[:, 2 * h :]))
        s = n + z * (s - n)
        states[t] = s
    return states, tape


def _unroll(w: dict, d: str, codes: np.ndarray, tape: list, grad: np.ndarray, out: dict) -> None:
    """Backpropagation through time of one direction; ``grad`` is that of its states."""
    u = w[f"u{d}"]
    h = u.shape[0]
    gx, gu, carry = np.zeros_like(w[f"x{d}"]), np.zeros_like(u), np.zeros(grad.shape[1:], "f4")
    for t, s, z, r, n, gn in reversed(tape):
        ds = grad[t] + carry
        dn = ds * (1 - z) * (1 - n * n)
        dz = ds * (s - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        np.add.at(gx, codes[t], da)
        gu += s.T @ dg
        carry = ds * z + dg @ u.T
    out[f"x{d}"], out[f"u{d}"] = gx, gu


def _probabilities(w: dict, codes: np.ndarray, keep: bool = False):
    f, tape_f = _sweep(w, "f", codes, keep)
    b, tape_b = _sweep(w, "b", codes, keep)
    both = np.concatenate([f, b], 2)
    p = both @ w["o"] + w["c"]
    p -= p.max(2, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(2, keepdims=True)
    return p, (both, tape_f, tape_b)


def gradients(w: dict, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions that are no padding, and its gradients; target is a class for each row."""
    p, (both, tape_f, tape_b) = _probabilities(w, codes, True)
    real = (codes < 256).astype("f4")
    real /= max(1.0, float(real.sum()))
    rows = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, rows, target] + 1e-9) * real).sum())
    p[:, rows, target] -= 1
    p *= real[:, :, None]
    out = {"o": np.einsum("tbh,tbk->hk", both, p, optimize=True), "c": p.sum((0, 1))}
    back = p @ w["o"].T
    h = back.shape[2] // 2
    _unroll(w, "f", codes, tape_f, back[:, :, :h], out)
    _unroll(w, "b", codes, tape_b, back[:, :, h:], out)
    return loss, out


def train(texts: list[bytes], langs: list[str], steps: int = STEPS) -> Model:
    """Fit a network to windows of ``texts``; each window of a document carries the document's language."""
    names = sorted(set(langs))
    model = _start(names)
    if len(names) < 2:
        return model
    rng = np.random.default_rng(SEED)
    by = [[np.frombuffer(t, np.uint8) for t, x in zip(texts, langs, strict=True) if x == n and t] for n in names]
    by = [x if x else [np.zeros(1, np.uint8)] for x in by]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(names), BATCH)
        codes = np.full((TRAIN_SPAN, BATCH), 256, np.int64)
        for k, c in enumerate(target.tolist()):
            text = by[c][rng.integers(len(by[c]))]
            at = rng.integers(max(1, len(text) - TRAIN_SPAN + 1))
            part = text[at : at + TRAIN_SPAN]
            codes[: len(part), k] = part
        _, grads = gradients(model.w, codes, target)
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grads.items():  # Adam, with clipped gradients
            g = g * min(1.0, 1.0 / (size + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return model


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all positions of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    spans = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), spans)
    grid = np.full((int(spans.sum()), SPAN), 256, np.int16)
    row = np.cumsum(spans) - spans
    for t, r, n in zip(texts, row.tolist(), sizes.tolist(), strict=True):
        grid.reshape(-1)[r * SPAN : r * SPAN + n] = np.frombuffer(t, np.uint8)
    sums = np.zeros((len(texts), len(model.langs)))
    order = np.argsort(-np.minimum(SPAN, sizes[owner] - SPAN * (np.arange(len(owner)) - row[owner])), kind="stable")
    side = max(1, 1024 * 64 // max(64, len(model.langs)))  # fewer where each has more probabilities
    for at in range(0, len(grid), side):  # spans of like length side by side
        own = order[at : at + side]
        codes = grid[own]
        length = int((codes < 256).sum(1).max())
        codes = np.ascontiguousarray(codes[:, :length].T)
        p, _ = _probabilities(model.w, codes)
        np.add.at(sums, owner[own], (p * (codes < 256)[:, :, None]).sum(0))
    return sums / np.maximum(1, sizes)[:, None]


def training_sample(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[bytes], list[str]]:
    """About ``most`` documents (text, lang) of ``docs``, as many of each language, cut to TRAIN_BYTES.

    Rows are chosen by a hash of the id. Every language gives a row at least, also where there are more of them than
    ``most``; their names and counts are one small table, as the model has weights for each.
    """
    at = F.floor(F.rand(SEED) * F.greatest(F.lit(1), F.length("text") - F.lit(TRAIN_BYTES // 2)))
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not share:
        return [], []
    each = max(1, most // len(share))
    part = F.substring("text", 1 + at.cast("int"), TRAIN_BYTES // 2).alias("text")

    def of(chosen: list[tuple[str, float]]) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, rate double")), "lang")

    lucky = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) < F.col("rate") * 1_000_003
    some = of([(r["lang"], min(1.0, 1.2 * each / r["n"])) for r in share])
    got = some.filter(lucky).select("lang", part).limit(2 * max(most, len(share))).collect()
    missed = {r["lang"] for r in share} - {r["lang"] for r in got}
    if missed:  # no row of theirs was chosen: the one of the smallest hash
        one = of([(x, 1.0) for x in sorted(missed)]).select("lang", F.xxhash64("doc_id", F.lit(SEED)).alias("turn"), part)
        got += one.groupBy("lang").agg(F.min(F.struct("turn", "text")).getField("text").alias("text")).collect()
    return [r["text"].encode() for r in got], [r["lang"] for r in got]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with lang_pred and score; the model is a few tens of kilobytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = batch.column("text").to_pylist()
            known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            own = [k for k, x in enumerate(known) if x]
            if own and model.langs:
                p = pooled(model, [texts[k].encode() for k in own])
                for k, c, s in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    best[k], score[k] = model.langs[c], min(1.0, s)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(
    docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on rows that ``held_out`` does not mark, predicted for all.

    Every byte of every text is labelled, span by span; the document takes the mean of the probabilities. A null text, or
    one without a letter, is ``und`` with score 0; so is every text if no row teaches a language. Repeated rows get equal
    results. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    return predict(docs, train(*training_sample(docs.filter(~F.col("held_out")))))
