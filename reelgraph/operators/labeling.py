"""Zero-shot labels: similarity to label prototypes, boosts from corrected examples, label selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions.vectors import softmax
from reelgraph.operators import kernels as K
from reelgraph.operators.pooling import pool_vectors
from reelgraph.session import cut

LOGIT_SCALE = 50.0
MIN_CONFIDENCE_SIM = 0.18
REL_MARGIN = 0.40
MIN_PROB = 0.03
MAX_LABELS = 3
BOOST_FLOOR, BOOST_TOP, BOOST_WEIGHT = 0.80, 1.0, 0.05
FALLBACK_LABEL = "video"
VOCABULARY_BYTES = 32 << 20  # a vocabulary up to here is sent to every task


def label_prompts(labels: DataFrame) -> DataFrame:
    """(label, prompt): every prompt of a label and "a video of " before its first one."""
    phrased = F.concat(F.lit("a video of "), F.element_at("prompts", 1))
    return labels.select("label", F.explode(F.concat("prompts", F.array(phrased))).alias("prompt"))


def label_prototypes(prompt_vectors: DataFrame) -> DataFrame:
    """(label, embedding): unit mean of the prompt vectors of a label."""
    return pool_vectors(prompt_vectors, ["label"])


def exemplar_boost(sim):
    """Boost of one corrected example as a column of its similarity."""
    clipped = F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0))
    return F.when(
        clipped > BOOST_FLOOR, F.lit(BOOST_WEIGHT) * (clipped - BOOST_FLOOR) / (BOOST_TOP - BOOST_FLOOR)
    ).otherwise(F.lit(0.0))


def label_similarities(
    items: DataFrame, label_vectors: DataFrame, *, id_col: str = "id", vec: str = "embedding"
) -> DataFrame:
    """(item_id, label_ord, sim) for every item and label."""
    return K.join_scores(
        label_vectors.select(F.col("label_ord").cast("long").alias("_l"), F.col(vec)),
        items.select(F.col(id_col).cast("long").alias("_id"), F.col(vec)),
        K.all_scores(), "item_id long, label_ord long, sim double", small_keys=["_l"], large_keys=["_id"], vec=vec,
    )


def feedback_boosts(
    items: DataFrame, feedback: DataFrame, label_vectors: DataFrame, *, id_col: str = "id", vec: str = "embedding",
    floor: float = BOOST_FLOOR, broadcast_bytes: int | None = None,
) -> DataFrame:
    """(item_id, label_ord, boost): sum over the corrected examples of a known label; zero vectors never count."""
    known = label_vectors.select(F.col("label").alias("corrected_label"), F.col("label_ord").cast("long").alias("_l"))
    exemplars = feedback.filter(F.col(vec).isNotNull()).join(known, "corrected_label").select("_l", vec)
    parts = K.join_scores(
        exemplars, items.select(F.col(id_col).cast("long").alias("_id"), F.col(vec)),
        K.exemplar_boosts(floor, BOOST_TOP, BOOST_WEIGHT), "item_id long, label_ord long, boost double",
        small_keys=["_l"], large_keys=["_id"], vec=vec, broadcast_bytes=broadcast_bytes,
    )
    return parts.groupBy("item_id", "label_ord").agg(F.sum("boost").alias("boost"))


def classify(
    items: DataFrame, label_vectors: DataFrame, feedback: DataFrame | None = None, *, id_col: str = "id",
    vec: str = "embedding", boost_floor: float = BOOST_FLOOR, min_sim: float = MIN_CONFIDENCE_SIM,
    vocabulary_bytes: int | None = None,
) -> DataFrame:
    """(item_id, label): up to three labels within 40 % of the most probable one, joined by ", ".

    The similarities of an item stay one array next to it, so selecting labels needs no shuffle; only items with
    boosts meet a join. Label ties go to the lower ``label_ord``. A vocabulary above ``vocabulary_bytes`` is not sent to
    the tasks; its similarities then are rows, with the same result.
    """
    vocabulary = label_vectors.select(F.col("label_ord").cast("long").alias("label_ord"), "label", vec)
    n, width = K.shape(vocabulary, vec)
    if n * width * 8 > (VOCABULARY_BYTES if vocabulary_bytes is None else vocabulary_bytes):
        return _classify_by_rows(items, label_vectors, feedback, id_col, vec, boost_floor, min_sim)
    table = vocabulary.orderBy("label_ord").toArrow()
    held = items.sparkSession.sparkContext.broadcast(K.unit(K.matrix(table.column(vec))))
    names = F.array(*[F.lit(x) for x in table.column("label").to_pylist()])
    ords = table.column("label_ord").to_pylist()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sims = K.similarities(K.unit(K.matrix(batch.column(vec))), held.value)
            starts = pa.array(np.arange(0, sims.size + 1, sims.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(starts, pa.array(sims.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "sims"])

    scored = items.select(F.col(id_col).cast("long").alias("item_id"), vec).mapInArrow(
        score, "item_id long, sims array<double>"
    )
    if feedback is not None:
        boosts = feedback_boosts(items, feedback, label_vectors, id_col=id_col, vec=vec, floor=boost_floor)
        per_item = boosts.groupBy("item_id").agg(
            F.map_from_entries(F.collect_list(F.struct("label_ord", "boost"))).alias("_boosts")
        )
        positions = F.array(*[F.lit(o) for o in ords])
        boosted = F.zip_with(
            "sims", positions, lambda s, o: s + F.coalesce(F.element_at("_boosts", o), F.lit(0.0))
        )
        scored = scored.join(per_item, "item_id", "left").select(
            "item_id", F.when(F.col("_boosts").isNull(), F.col("sims")).otherwise(boosted).alias("sims")
        )
    probs = scored.select("item_id", F.array_max("sims").alias("best"), softmax("sims", LOGIT_SCALE).alias("probs"))
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    top = probs.select("item_id", "best", F.slice(ranked, 1, MAX_LABELS).alias("top"))
    best = -F.element_at("top", 1)["p"]
    kept = F.filter(
        "top", lambda t, i: (-t["p"] >= F.lit(REL_MARGIN) * best) & ((-t["p"] >= MIN_PROB) | (i == 0))
    )
    label = F.array_join(F.transform(kept, lambda t: F.element_at(names, t["i"] + 1)), ", ")
    return top.select(
        "item_id", F.when(F.col("best") < min_sim, F.lit(FALLBACK_LABEL)).otherwise(label).alias("label")
    )


def _classify_by_rows(
    items: DataFrame, label_vectors: DataFrame, feedback: DataFrame | None, id_col: str, vec: str, boost_floor: float, min_sim: float
) -> DataFrame:
    """``classify`` with a row for each item and label, aggregated per item."""
    sims = label_similarities(items, label_vectors, id_col=id_col, vec=vec)
    if feedback is not None:
        boosts = feedback_boosts(items, feedback, label_vectors, id_col=id_col, vec=vec, floor=boost_floor)
        joined = sims.join(boosts, ["item_id", "label_ord"], "left")
        sims = joined.select("item_id", "label_ord", (F.col("sim") + F.coalesce("boost", F.lit(0.0))).alias("sim"))
    sims = cut(sims)
    best = sims.groupBy("item_id").agg(F.max("sim").alias("best"))
    weight = F.exp(F.lit(LOGIT_SCALE) * (F.col("sim") - F.col("best")))
    weighed = sims.join(best, "item_id").withColumn("e", weight)
    total = weighed.groupBy("item_id").agg(F.sum("e").alias("total"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sim"), "label_ord"))
    top = weighed.withColumn("rank", place).filter(F.col("rank") <= MAX_LABELS).join(total, "item_id")
    p = F.col("e") / F.col("total")  # the best one weighs 1
    kept = top.filter((F.col("e") >= REL_MARGIN) & ((p >= MIN_PROB) | (F.col("rank") == 1)))
    named = kept.join(label_vectors.select(F.col("label_ord").cast("long").alias("label_ord"), "label"), "label_ord")
    texts = named.groupBy("item_id", "best").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("l"))
    label = F.array_join(F.transform("l", lambda x: x["label"]), ", ")
    return texts.select("item_id", F.when(F.col("best") < min_sim, F.lit(FALLBACK_LABEL)).otherwise(label).alias("label"))
