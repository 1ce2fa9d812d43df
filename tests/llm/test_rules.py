from collections import Counter

from reelgraph.llm import rules
from tests.llm import data


def plain(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:]))
    repeats = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    duplicates = sum(x in lines[:k] for k, x in enumerate(lines))
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(repeats) > 50 * len(words)
    return len(words), chars, symbols, duplicates, len(repeats), failed


def test_measures(spark):
    for df, rows in ((data.documents(spark), data.texts()), (data.table(spark, "documents"), data.pairs(spark))):
        got = [tuple(r) for r in rules.quality_rules(df).collect()]
        assert sorted((g[:-1] for g in got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
        assert not any(kept and failed for *_, failed, kept in got)


def test_order_never_matters(spark):
    docs = [rules.Doc(t) for _, t in data.texts() + data.pairs(spark)]
    every = rules.BASE + rules.RULES
    want = [not any(r.rejects(d) for r in every) for d in docs]
    assert want == [not any(r.rejects(d) for r in reversed(every)) for d in docs]
    assert 0 < sum(want) < len(want)
    kept = data.result(rules.keep_passing(data.documents(spark)).select("doc_id"))
    assert [r["doc_id"] for r in kept] == sorted(
        (i for (i, _), w in zip(data.texts(), want, strict=False) if w), key=lambda i: (i is not None, i)
    )


def test_order_is_by_rejections_per_cost(spark):
    slow = rules.Rule("slow", lambda d: sum(range(20_000)) < 0)
    quick = rules.Rule("quick", lambda d: True)
    assert [r.name for r in rules.ordered(data.documents(spark), (slow, quick))] == ["quick", "slow"]


def test_the_sample_comes_from_all_rows(spark):
    texts = spark.range(0, 20_000, 1, 4).selectExpr("if(id < 15000, 'x', 'y') AS text")
    ((name, _, share),) = rules.estimates(texts, (rules.Rule("late", lambda d: d.text == "y"),))
    assert name == "late" and 0.2 < share < 0.3


def test_short_circuit():
    asked = []
    cascade = (rules.Rule("a", lambda d: True), rules.Rule("b", lambda d: asked.append(1)))
    assert any(r.rejects(rules.Doc("x")) for r in cascade) and not asked


def test_empty_table(spark):
    assert rules.quality_rules(data.documents(spark, [])).count() == 0
