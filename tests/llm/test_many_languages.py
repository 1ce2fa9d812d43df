from collections import Counter

from reelgraph.llm import language


def table(spark, n):
    """Languages of 3 rows, one of 200, and one that a hash of the id leaves out unless it is asked for."""
    rows = [(k, f"text {k} of one", f"l{k % n:03}") for k in range(3 * n)] + [(10_000 + k, f"text {k}", "large") for k in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    texts, langs = language.training_sample(table(spark, 90))
    assert len(texts) == len(langs) and set(langs) == {f"l{k:03}" for k in range(90)} | {"large"}
    assert max(Counter(langs).values()) <= 2 * 4000 // 91
    assert language.train(texts, langs, steps=1).langs == sorted(set(langs))


def test_more_languages_than_rows_to_learn_from(spark):
    _, langs = language.training_sample(table(spark, 90), most=20)
    assert set(langs) == {f"l{k:03}" for k in range(90)} | {"large"}


def test_many_probabilities_side_by_side():
    model = language._start([f"l{k:03}" for k in range(200)])
    p = language.pooled(model, [b"abc def " * 3000, b"x"])
    assert p.shape == (2, 200) and abs(p.sum(1) - 1).max() < 1e-3
