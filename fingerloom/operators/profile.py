"""Profiling tables: missing values, duplicates, summary statistics, correlation, histograms, box plots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions.scalars import number, number_sql, to_number
from fingerloom.operators.quantiles import exact_quantiles
from fingerloom.schema import IQR_MULTIPLIER, TARGET


def label_distribution(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def profile_missing(df: DataFrame) -> DataFrame:
    """Columns with NULL (or NaN) values and their number, in one pass."""
    def absent(field: T.StructField):
        c = F.col(field.name)
        return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    row = df.agg(*[F.count_if(absent(f)).alias(f.name) for f in df.schema])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns]
    return row.select(F.inline(F.array(*entries))).where("n_missing > 0").orderBy(F.desc("n_missing"), "column_name")


def profile_duplicates(df: DataFrame, key: str = "session_id") -> DataFrame:
    """Surplus copies of whole rows and of the key. Copies are counted before the shuffle."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))
    out = rows.select(F.lit("rows").alias("scope"), "n_duplicates")
    if key in df.columns:
        keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))
        out = out.union(keys.select(F.lit(key), "n_duplicates"))
    return out


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    numbers = df.selectExpr(*[f"{number_sql(c)} AS `{c}`" for c in columns])
    measures = {"n_values": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    aggregates = [F.expr(f"{f}(`{c}`) AS `{n}_{c}`") for c in columns for n, f in measures.items()]
    entries = []
    for c in columns:
        q = [("NULL" if v is None else number(v)) for v in quartiles[c] or [None] * 3]
        parts = [f"`{n}_{c}` AS {n}" for n in measures]
        parts += [f"double({v}) AS {n}" for v, n in zip(q, ("q25", "q50", "q75"))]
        entries.append(f"struct('{c}' AS column_name, {', '.join(parts)})")
    return numbers.agg(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, distinct values, most frequent value (smallest wins a tie) and its frequency per column.

    Values are counted per column with map-side combine, then the counts are reduced.
    """
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("_value")) for c in columns]
    counts = (df.select(F.inline(F.array(*entries))).where(F.col("_value").isNotNull())
              .groupBy("column_name", "_value").agg(F.count(F.lit(1)).alias("_n")))
    first = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("value")))
    return counts.groupBy("column_name").agg(
        F.sum("_n").alias("n_values"), F.count(F.lit(1)).alias("n_unique"), first.alias("_top"),
    ).select("column_name", "n_values", "n_unique", F.col("_top.value").alias("top"),
             (-F.col("_top.n")).alias("freq"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, over the rows where both are present.

    Each Arrow batch is reduced to pair sums by matrix products around fixed centres, then the sums
    are added up: a few hundred numbers per batch are shuffled, whatever the number of rows.
    """
    columns = list(columns)
    numbers = df.selectExpr(*[f"{number_sql(c)} AS `{c}`" for c in columns])
    means = numbers.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] or 0.0 for c in columns])
    k = len(columns)

    def sums(batches):
        total = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        import pandas as pd

        i, j = np.indices((k, k)).reshape(2, -1)
        flat = total.reshape(6, -1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{m}": flat[m] for m in range(6)}})

    parts = numbers.mapInPandas(sums, "i int, j int, " + ", ".join(f"s{m} double" for m in range(6)))
    added = parts.groupBy("i", "j").agg(*[F.sum(f"s{m}").alias(f"s{m}") for m in range(6)])
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{m}") for m in range(6))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    names = F.array(*[F.lit(c) for c in columns])
    return added.select(
        F.get(names, F.col("i")).alias("column_x"), F.get(names, F.col("j")).alias("column_y"),
        F.when((n > 1) & (vx > 0) & (vy > 0), (sxy - sx * sy / n) / F.sqrt(vx * vy)).alias("correlation"))


def histogram_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max with counts, empty bins included; the last bin is closed."""
    x = to_number(F.col(column))
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    if ends["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n_rows bigint")
    low, high = float(ends["low"]), float(ends["high"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


def boxplot_stats(df: DataFrame, column: str) -> DataFrame:
    """Five-number summary of a column before and after keeping the rows inside its IQR bounds."""
    out, rows, x = None, df, to_number(F.col(column))
    for stage in ("before", "after"):
        quartiles = exact_quantiles(rows, [column], (0.25, 0.5, 0.75))[column]
        if quartiles is None:
            break
        q1, median, q3 = quartiles
        fits = x.between(q1 - IQR_MULTIPLIER * (q3 - q1), q3 + IQR_MULTIPLIER * (q3 - q1))
        inside = F.when(fits, x)
        part = rows.agg(
            F.lit(stage).alias("stage"), F.count(x).alias("n_rows"), F.min(inside).alias("whisker_low"),
            F.lit(q1).alias("q1"), F.lit(median).alias("median"), F.lit(q3).alias("q3"),
            F.max(inside).alias("whisker_high"), F.count_if(~fits).alias("n_fliers"))
        out = part if out is None else out.union(part)
        rows = rows.where(fits)
    return out
