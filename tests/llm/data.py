"""Small documents with every odd case, and the tables of the smallest scale."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("fp", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("ids", T.StringType()),
    T.StructField("component_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("score", T.StringType()),
])

_RANDOM = random.Random(5)
VOCABULARY = ["".join(_RANDOM.choices("abcdefghij", k=_RANDOM.randint(2, 8))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def texts() -> list[tuple[int | None, str | None]]:
    passage = "This passage of well over fifty bytes stands in several of the documents, word for word. "
    base = prose(120, 1)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, near), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "Über ß é 日本 🙂"),
        (10, "MIT License and mit license; the Apache License, General-Public License"),
        (11, prose(60, 2) + passage + prose(60, 3)), (12, prose(70, 4) + passage + prose(50, 5)), (13, passage), (13, passage),
        (14, "x" * 3000), (15, "x" * 49), (16, "x" * 50), (17, "word " * 400), (18, "*** # $ %" * 50), (19, "<|endoftext|> a  b"),
        (20, "line one here\nline one here\n\n \nline two"), (21, prose(5000, 6)), (22, prose(5000, 6)[:-5] + " tail"),
        (None, base), (None, prose(80, 7)), (23, "\x00\x1f control \x85 \xa0 mixed　space"), (24, "é" * 60), (25, "aé" + "é" * 59),
        (26, "LICENSE " * 300 + "mit " * 10), (-3, prose(90, 8)), (27, prose(90, 8)),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ["en", "de", None][k % 3], "s", len(t or ""), "x", "x", "x", "x", "x", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark, folder=SMALL):
    return [(r["doc_id"], r["text"]) for r in table(spark, "documents", folder).select("doc_id", "text").collect()]


def result(df, *key):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[k] is not None, r[k]) for k in (key or df.columns)))


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
