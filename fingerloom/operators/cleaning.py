"""Timing-outlier rules: negatives, hard caps and IQR bounds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions import scalars as S
from fingerloom.functions.scalars import number
from fingerloom.operators.quantiles import exact_quantiles
from fingerloom.schema import DWELL_CAP_MS, FLIGHT_CAP_MS, IQR_MULTIPLIER


@dataclass(frozen=True)
class Bounds:
    q1: float
    q3: float
    iqr: float
    lower: float
    upper: float


def timing_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Dwell and flight columns of a frame by name prefix."""
    return ([c for c in df.columns if c.startswith("dwell_")], [c for c in df.columns if c.startswith("flight_")])


def default_caps(df: DataFrame, dwell_cap: float = DWELL_CAP_MS, flight_cap: float = FLIGHT_CAP_MS) -> dict[str, float]:
    dwell, flight = timing_columns(df)
    return {**{c: dwell_cap for c in dwell}, **{c: flight_cap for c in flight}}


def within(limits: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """True if every column lies within its (low, high); NULL and NaN count as inside.

    One short conjunct per column, given as SQL text: a wide rule is one call to the planner.
    """
    tests = []
    for c, (low, high) in limits.items():
        ends = [f"`{c}` >= {number(low)}"] if low is not None else []
        ends += [f"`{c}` <= {number(high)}"] if high is not None else []
        tests.append(f"({' AND '.join(ends) or 'true'} OR `{c}` IS NULL OR isnan(`{c}`))")
    return F.expr(" AND ".join(tests) or "true")


def as_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text columns among ``columns`` as doubles; numeric ones are left as they are."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: S.to_number(F.col(c)) for c in text}) if text else df


def not_negative(columns: Iterable[str]) -> Column:
    return within({c: (0.0, None) for c in columns})


def under_cap(caps: Mapping[str, float]) -> Column:
    return within({c: (None, cap) for c, cap in caps.items()})


def under_upper(bounds: Mapping[str, Bounds]) -> Column:
    return within({c: (None, b.upper) for c, b in bounds.items()})


def inside(bounds: Mapping[str, Bounds]) -> Column:
    return within({c: (b.lower, b.upper) for c, b in bounds.items()})


def _plausible(df: DataFrame, columns: Sequence[str], caps: Mapping[str, float]) -> dict[str, tuple[float, float | None]]:
    """Limits of negatives and caps together, of the columns present."""
    return {c: (0.0 if c in columns else None, caps.get(c)) for c in [*columns, *(k for k in caps if k not in columns)]
            if c in df.columns}


def drop_negative(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or sum(timing_columns(df), [])
    return as_numbers(df, columns).where(not_negative(columns))


def drop_over_cap(df: DataFrame, caps: Mapping[str, float] | None = None) -> DataFrame:
    caps = default_caps(df) if caps is None else caps
    return as_numbers(df, caps).where(under_cap(caps))


def iqr_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER) -> dict[str, Bounds]:
    """Exact quartile bounds of every column that has a value. One row reaches the driver."""
    out = {}
    for name, quartiles in exact_quantiles(df, columns, (0.25, 0.75)).items():
        if quartiles is None:
            continue
        q1, q3 = quartiles
        iqr = q3 - q1
        out[name] = Bounds(q1, q3, iqr, q1 - multiplier * iqr, q3 + multiplier * iqr)
    return out


def drop_over_iqr(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Drop rows over the upper bound of any column, all bounds taken from the same input."""
    columns = columns or sum(timing_columns(df), [])
    return as_numbers(df, columns).where(under_upper(iqr_bounds(df, columns, multiplier)))


def clean_timing(df: DataFrame, *, dwell_cap: float = DWELL_CAP_MS, flight_cap: float = FLIGHT_CAP_MS,
                 multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Negatives, then hard caps, then the IQR upper bound; unchanged without timing columns.

    The bounds are literals, so the cleaning pass is a plain filter next to the scan: per column, the
    lower of cap and IQR bound is the only upper limit left.
    """
    columns = sum(timing_columns(df), [])
    if not columns:
        return df
    df = as_numbers(df, columns)
    limits = _plausible(df, columns, default_caps(df, dwell_cap, flight_cap))
    bounds = iqr_bounds(df.where(within(limits)), columns, multiplier)
    return df.where(within({
        c: (low, min(high, bounds[c].upper) if c in bounds else high) for c, (low, high) in limits.items()}))


def cleaning_audit(df: DataFrame, *, label: str | None = None) -> DataFrame:
    """Rows lost at each stage of :func:`clean_timing`, in one pass after the bounds; optionally per label."""
    columns = sum(timing_columns(df), [])
    df = as_numbers(df, columns)
    caps = default_caps(df)
    bounds = iqr_bounds(df.where(within(_plausible(df, columns, caps))), columns)
    staged = df.select(
        *([label] if label else []),
        F.when(~not_negative(columns), "negative").when(~under_cap(caps), "hard_cap")
        .when(~under_upper(bounds), "iqr").otherwise("kept").alias("stage"))
    hit = lambda s: F.count_if(F.col("stage") == s)
    aggregates = [
        F.count(F.lit(1)).alias("rows_before"), hit("negative").alias("negative_rows"),
        hit("hard_cap").alias("hard_cap_rows"), hit("iqr").alias("iqr_rows"), hit("kept").alias("rows_after")]
    return staged.groupBy(*([label] if label else [])).agg(*aggregates)


def flag_two_sided(df: DataFrame, columns: Sequence[str], caps: Mapping[str, float] | None = None,
                   multiplier: float = IQR_MULTIPLIER) -> tuple[DataFrame, dict[str, Bounds]]:
    """Rows with ``status``: ``clean``, ``outlier``, or ``rejected`` (negative or over a cap), and the bounds.

    A row without a value in a column is not an outlier for it.
    """
    columns = [c for c in columns if c in df.columns]
    caps = {c: v for c, v in (caps or {}).items() if c in df.columns}
    if not columns:
        return df.withColumn("status", F.lit("clean")), {}
    df = as_numbers(df, [*columns, *caps])
    plausible = within(_plausible(df, columns, caps))
    bounds = iqr_bounds(df.where(plausible), columns, multiplier)
    status = F.when(~plausible, "rejected").when(~inside(bounds), "outlier").otherwise("clean")
    return df.withColumn("status", status), bounds


def keep_inside_iqr(df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Rows with a value inside both bounds of one column."""
    bounds = iqr_bounds(df, [column], multiplier).get(column)
    if bounds is None:
        return df.where(F.lit(False))
    return df.where(S.to_number(F.col(column)).between(bounds.lower, bounds.upper))


def keep_domain_range(df: DataFrame) -> DataFrame:
    """Speed within 0..250 and accuracy within 0..1, each only if the column exists; NULLs are dropped."""
    for column, high in (("wpm", 250), ("accuracy", 1)):
        if column in df.columns:
            df = df.where(S.nan_to_null(F.col(column).cast("double")).between(0, high))
    return df
