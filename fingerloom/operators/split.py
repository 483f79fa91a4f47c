"""Seeded stratified folds and train/test split.

Rows are ranked inside their class by a seeded hash of the row key, so class proportions are exact
and the assignment depends neither on the partitioning nor on the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.functions.draws import order_hash
from fingerloom.operators.ordering import with_group_rank

_HASH = "_hash"


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn(_HASH, order_hash(F.col(key), seed))
    return with_group_rank(hashed, label, [_HASH, key], "_rank", "_size").drop(_HASH)


def stratified_folds(df: DataFrame, label: str, key: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..folds-1; fold sizes differ by at most one row per class."""
    ranked = _ranked(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_size")


def stratified_split(df: DataFrame, label: str, key: str, *, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first ``ceil(share * n)`` rows of every class in hash order."""
    ranked = _ranked(df, label, key, seed)
    is_test = F.col("_rank") <= F.ceil(F.col("_size") * F.lit(test_share))
    return ranked.withColumn("is_test", is_test.cast("int")).drop("_rank", "_size")


def carry_forward(df: DataFrame, user: str, position: str, value: str, *, block: int = 10_000) -> DataFrame:
    """Fill NULLs of ``value`` with the last earlier non-NULL value of the same user.

    ``position`` counts a user's rows from 0. The window runs inside blocks of ``block`` rows; what a
    block inherits comes from a summary with one row per block, so a user with most of the rows does
    not end in one task.
    """
    numbered = df.withColumn("_block", F.floor(F.col(position) / block))
    inside = Window.partitionBy(user, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    filled = numbered.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    # max_by skips rows whose order is NULL: the last value of the block, or NULL if it has none.
    summary = numbered.groupBy(user, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_last"))
    before = Window.partitionBy(user).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inherited = summary.select(user, "_block", F.last("_last", ignorenulls=True).over(before).alias("_inherited"))
    return (
        filled.join(inherited, [user, "_block"])
        .withColumn(value, F.coalesce(F.col(value), F.col("_inherited")))
        .drop("_block", "_inherited")
    )
