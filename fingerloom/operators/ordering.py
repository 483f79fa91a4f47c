"""Row numbers over a total order without a one-task window.

Rows are range-partitioned by the order key and numbered inside their partition; the offsets of the
partitions come from a summary with one row per partition. Range bounds are sampled, so the numbered
frame is checkpointed before the summary is taken: both passes then see the same partitions, also
after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.session import checkpointed

_PART, _POS = "_part", "_pos"
# Rows of three numbers and a group value: some ten megabytes.
MAX_BROADCAST_ROWS = 100_000


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partitioned, sorted and checkpointed rows with partition number and position."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rid = F.monotonically_increasing_id()
    return checkpointed(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumns({_PART: F.shiftright(rid, 33), _POS: rid.bitwiseAND(F.lit((1 << 33) - 1))})
    )


def with_sequence(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Add 1..n in the order of ``order``, whose columns must identify a row."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy(_PART).agg(F.max(_POS).alias("_last"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_before"))
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    return (
        ranged.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + F.col(_POS) + 1)
        .drop(_PART, _POS, "_before")
    )


def with_group_rank(df: DataFrame, group: str, order: Sequence[str], name: str = "rank",
                    size: str | None = None) -> DataFrame:
    """Add 1..n inside each value of ``group`` in the order of ``order``, and the group's row count as
    ``size`` if a name is given; NULL is a group of its own.

    A group may span any number of partitions, so a group with most of the rows is still numbered in
    parallel.
    """
    ranged = _ranged(df, [group, *order])
    # One row per group in each partition: at most partitions + groups rows.
    runs = checkpointed(ranged.groupBy(_PART, group).agg(F.min(_POS).alias("_first"), F.count(F.lit(1)).alias("_n")))
    inside = Window.partitionBy(group)
    before = inside.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col(_PART), F.col(group).alias("_group"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(inside).alias("_total"))
    if runs.count() <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    same = (ranged[_PART] == offsets[_PART]) & ranged[group].eqNullSafe(offsets["_group"])
    out = ranged.join(offsets, same).withColumn(name, F.col("_before") + F.col(_POS) - F.col("_first") + 1)
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.drop(offsets[_PART]).drop(_PART, _POS, "_first", "_group", "_before", "_total")
