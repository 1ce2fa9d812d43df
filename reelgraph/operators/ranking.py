"""Positions and running totals over a whole table without sending it through one partition.

The table is range-partitioned and sorted; each row gets its place inside its partition, and the sizes (or totals)
of the earlier partitions, one row per partition, give the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.session import cut

_PLACE_BITS = 33  # layout of monotonically_increasing_id: partition number, then place in the partition


def _sorted_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("_mid", F.monotonically_increasing_id())).withColumns(
        {"_part": F.shiftright("_mid", _PLACE_BITS), "_place": F.col("_mid").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}
    )


def _offsets(parts: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Totals of the earlier partitions; one row per partition, so the one-partition window is bounded."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = parts.groupBy("_part").agg(*[total.alias(name) for name, total in totals.items()])
    return per_part.select(
        "_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in totals]
    )


def with_row_number(df: DataFrame, *order: Column | str, name: str = "row_number") -> DataFrame:
    """1-based position in ``order``; end the order on a unique key."""
    parts = _sorted_parts(df, [F.col(o) if isinstance(o, str) else o for o in order])
    offsets = F.broadcast(_offsets(parts, {"_before": F.count(F.lit(1))}))
    return parts.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_place") + 1).cast("long").alias(name)
    )


def with_running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` along ``order``, which must have no ties."""
    parts = _sorted_parts(df, order)
    offsets = F.broadcast(_offsets(parts, {f"_o_{new}": F.sum(old) for new, old in sums.items()}))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(offsets, "_part").select(
        *df.columns, *[(F.sum(old).over(inside) + F.col(f"_o_{new}")).alias(new) for new, old in sums.items()]
    )


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each distinct ``key`` with its dense rank from 0, as a two-column table."""
    ranked = with_row_number(df.select(key).distinct(), key, name=name)
    return ranked.withColumn(name, F.col(name) - 1)
