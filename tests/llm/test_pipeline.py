import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reelgraph.llm import bpe, quality, rules
from tests.llm import data
from tests.llm.test_near_copies import expected as copies
from tests.llm.test_rules import plain
from tests.llm.test_suffix import expected as without_repeats


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_on_the_small_table(spark):
    folder = data.SMALL
    docs = data.table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    passed = steps["quality_rules"](spark, docs, folder).cache()
    assert passed.columns == docs.columns
    whole = rows_of(docs)
    want = {i for i, t in whole.items() if not plain(t)[-1] and not any(r.rejects(rules.Doc(t)) for r in rules.RULES)}
    assert set(rows_of(passed)) == want and len(want) < len(whole)

    good = steps["quality_classifier"](spark, passed, folder).cache()
    assert good.columns == docs.columns
    scored = quality.classify(passed, data.table(spark, "labels")).filter("predicted = 1")
    assert set(rows_of(good)) == {r["doc_id"] for r in scored.collect()}

    single = steps["near_duplicates"](spark, good, folder).cache()
    assert single.columns == docs.columns
    assert set(rows_of(single)) == {least for _, least in copies(sorted(rows_of(good).items()))}

    cut = steps["repeated_passages"](spark, single, folder).cache()
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes)
    before, after = rows_of(single), rows_of(cut)
    for doc, n, removed, _, _ in without_repeats(sorted(before.items())):
        if removed == 0:
            assert after[doc] == before[doc]
        else:
            assert n - removed - 8 <= len(after[doc].encode()) <= n - removed
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    pieces = sorted((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in steps["packing"](spark, cut, folder).collect())
    ids = {}
    for doc, _, part in pieces:
        ids.setdefault(doc, []).extend(part)
    assert ids == {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in after.items()}


def test_run_and_odd_documents(spark, tmp_path):
    data.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    data.table(spark, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter(F.col("length") <= 0).count() == 0 and out.count() > 0
    data.documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    data.table(spark, "labels").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
