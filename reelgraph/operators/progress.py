"""Job progress and throughput over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.operators.ranking import with_row_number

KEEP, NEW = 0.7, 0.3
MIN_OBSERVATIONS = 3


def job_progress(events: DataFrame, totals: DataFrame) -> DataFrame:
    """``events`` (job, seq, ts) with processed, percent, mean seconds per item and ETA; ``totals`` is (job, total).

    The running count is a difference of positions over the whole table, so one long job is not one task.
    """
    placed = with_row_number(events.select("job", "seq", "ts"), "job", "seq", name="_rn")
    starts = placed.groupBy("job").agg(F.min("_rn").alias("_first"), F.min_by("ts", "seq").alias("_start"))
    counted = placed.join(starts, "job").join(totals, "job").withColumns(
        {
            "processed": F.col("_rn") - F.col("_first") + 1,
            "_elapsed": F.col("ts").cast("double") - F.col("_start").cast("double"),
        }
    )
    mean = F.col("_elapsed") / F.col("processed")
    return counted.select(
        "job", "seq", "processed",
        (F.lit(100.0) * F.col("processed") / F.greatest("total", F.lit(1))).alias("percent"),
        mean.alias("mean_seconds"), (mean * (F.col("total") - F.col("processed"))).alias("eta_seconds"),
    )


def throughput_average(observations: DataFrame, key: str = "job") -> DataFrame:
    """(key, rate, n): exponential moving average of items/seconds in ``seq`` order; non-positive rows are ignored.

    The average is a linear recurrence, so it needs no ordered fold: an observation with ``age`` later ones weighs
    ``0.3 * 0.7**age`` (the first one of a key ``0.7**age``). Ages come from positions over the whole table, the
    weighted sum is an ordinary aggregate with partial sums.
    """
    valid = observations.filter((F.col("items") > 0) & (F.col("seconds") > 0)).select(
        key, "seq", (F.col("items") / F.col("seconds")).alias("_rate")
    )
    placed = with_row_number(valid, key, "seq", name="_rn")
    spans = placed.groupBy(key).agg(F.min("_rn").alias("_first"), F.max("_rn").alias("_last"))
    weight = F.pow(F.lit(KEEP), F.col("_last") - F.col("_rn")) * F.when(
        F.col("_rn") == F.col("_first"), F.lit(1.0)
    ).otherwise(F.lit(NEW))
    return placed.join(spans, key).groupBy(key).agg(
        F.sum(weight * F.col("_rate")).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def fold_averages(state: DataFrame, observations: DataFrame, key: str = "job") -> DataFrame:
    """New (key, rate, n) state after a batch of observations.

    k more observations turn an average r into ``0.7**k * r`` plus their weighted sum, so old state and new rows meet
    in one join of one row per key, whatever the size of a key.
    """
    new = throughput_average(observations, key).withColumnsRenamed({"rate": "_rate", "n": "_k"})
    # A key with state has no first observation in the batch: that one weighs 0.3 like the others.
    valid = observations.filter((F.col("items") > 0) & (F.col("seconds") > 0))
    first = valid.groupBy(key).agg(F.min_by(F.col("items") / F.col("seconds"), "seq").alias("_first"))
    both = state.join(new.join(first, key), key, "full_outer")
    excess = (F.lit(1.0) - NEW) * F.pow(F.lit(KEEP), F.col("_k") - 1) * F.col("_first")
    folded = F.pow(F.lit(KEEP), F.col("_k")) * F.col("rate") + F.col("_rate") - excess
    return both.select(
        key, F.coalesce(folded, "_rate", "rate").alias("rate"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("_k", F.lit(0))).alias("n"),
    )


def images_per_second(observed: DataFrame, default: float = 4.0, key: str = "job") -> DataFrame:
    """The observed rate once there are three observations, else the default."""
    return observed.select(key, F.when(F.col("n") >= MIN_OBSERVATIONS, F.col("rate")).otherwise(F.lit(default)).alias("rate"))
