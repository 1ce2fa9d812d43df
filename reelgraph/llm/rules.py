"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000  # rows, about, on which costs and rejections are estimated; they set the order, never the verdict
SEED = 42

SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
SPACES = " \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


class Doc:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # on bytes: space and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 4:
            return 0
        seen = Counter(zip(w, w[1:], w[2:]))
        if len(seen) == len(w) - 2:
            return 0
        total, covered = 0, 0  # words before ``covered`` are counted
        for i, gram in enumerate(zip(w, w[1:], w[2:])):
            if seen[gram] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or LETTER.search(w))

    @cached_property
    def n_upper_words(self) -> int:
        """Words of two or more ASCII letters and no lower-case one."""
        return sum(1 for w in self.words if w.isupper() and len(w) > 1)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return sum(map(bytes.__eq__, self.words[1:], self.words))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("letters", lambda d: 10 * d.n_letter_words < 6 * d.n_words),
    Rule("upper_case", lambda d: 2 * d.n_upper_words > d.n_words),
    Rule("stutter", lambda d: 10 * d.n_stutters > 3 * d.n_words),
)


def estimates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) over a sample of the whole table, about ``SAMPLE_ROWS`` rows of it.

    Rows are drawn where they are and only sums leave a task; one row a rule reaches the driver.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, hits, n = Counter(), Counter(), 0
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                for rule in rules:
                    doc = Doc(text)  # anew for each rule: its cost holds all that it needs
                    start = time.perf_counter()
                    hits[rule.name] += bool(rule.rejects(doc))
                    spent[rule.name] += time.perf_counter() - start
        yield pd.DataFrame([(r.name, spent[r.name], hits[r.name], n) for r in rules], columns=["rule", "s", "hits", "n"])

    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    sample = docs.select(F.col(text_col).alias("text")).sample(share, SEED)
    rows = sample.mapInPandas(measure, "rule string, s double, hits long, n long").groupBy("rule").agg(
        F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")
    ).collect()
    return [(r["rule"], r["s"] / max(r["n"], 1), r["hits"] / max(r["n"], 1)) for r in rows]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text") -> tuple[Rule, ...]:
    """The rules by rejections per second, highest first; names break ties."""
    rate = {name: (hits + 1e-6) / max(s, 1e-9) for name, s, hits in estimates(docs, rules, text_col)}
    return tuple(sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name)))


def passes(cascade: tuple[Rule, ...]) -> Callable[[Column], Column]:
    """A column function: does a text pass every rule? Rules after the first rejection are not computed."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        def verdict(text):
            doc = Doc(text)
            return not any(rule.rejects(doc) for rule in cascade)

        return pd.Series([verdict(t) for t in texts], dtype=bool)

    return kept


def measures_and_verdict(cascade: tuple[Rule, ...]) -> Callable[[Column], Column]:
    """A column function: the base measures of every text, and the verdict of the cascade on those that the base keeps."""

    @F.pandas_udf(MEASURES + ", kept boolean")
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            d = Doc(text)
            failed = any(rule.rejects(d) for rule in BASE)
            kept = not failed and not any(rule.rejects(d) for rule in cascade)
            rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")] + ["kept"])

    return measured


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the base measures, ``base_failed`` and ``kept``.

    A null text has no words and fails the base; so does an empty one. Very long texts are measured whole. Repeated
    rows get equal results. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured = measures_and_verdict(ordered(docs, RULES))
    return docs.select("doc_id", measured("text").alias("m")).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "m.kept"
    )


def keep_passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass base and rules, with all their columns."""
    return docs.filter(passes(ordered(docs, BASE + RULES, text_col))(F.col(text_col)))
