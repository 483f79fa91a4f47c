"""Exact interpolated quantiles of many columns."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions.scalars import number, number_sql

# The exact value inside a bracket is taken with one counter for each of its distinct values; a bracket with more is
# narrowed again.
MAX_BRACKET = 100_000
_ACCURACY = 10_000
_SLACK = 2.0 / _ACCURACY


def exact_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles per column, NULL and NaN ignored; None for a column without values.

    One way for any size: a first scan counts and brackets each wanted order statistic by approximate quantiles, a
    second counts what lies below and inside the brackets, and a third takes the exact value. Memory does not grow with
    the number of distinct values, and infinite values are values like any other.
    """
    levels = [float(p) for p in levels]
    columns = list(columns)
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in columns}
    values = df.selectExpr(*[f"double(`{c}`) AS `{c}`" if whole[c] else f"{number_sql(c)} AS `{c}`" for c in columns])
    near = [min(1.0, max(0.0, p + d)) for p in levels for d in (-_SLACK, _SLACK)]
    first = values.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns],
                       *[F.percentile_approx(c, near, _ACCURACY).alias(f"q_{c}") for c in columns]).first()
    counts = {c: first[f"n_{c}"] for c in columns}
    bracket: dict[tuple[str, int], tuple[float, float]] = {}
    for c in columns:
        for k, p in enumerate(levels):
            position = p * (counts[c] - 1)
            for r in {math.floor(position), math.ceil(position)} if counts[c] else ():
                low, high = first[f"q_{c}"][2 * k: 2 * k + 2]
                if (c, r) in bracket:
                    low, high = min(low, bracket[c, r][0]), max(high, bracket[c, r][1])
                bracket[c, r] = (low, high)
    ends = {c: (first[f"lo_{c}"], first[f"hi_{c}"]) for c in columns}
    return _interpolated(columns, levels, counts, _order_statistics(values, bracket, ends))


def _interpolated(columns: Sequence[str], levels: Sequence[float], counts: dict[str, int], order: dict) -> dict[str, list[float] | None]:
    out: dict[str, list[float] | None] = {}
    for c in columns:
        if not counts[c]:
            out[c] = None
            continue
        result = []
        for p in levels:
            position = p * (counts[c] - 1)
            low, high = order[c, math.floor(position)], order[c, math.ceil(position)]
            share = position - math.floor(position)
            result.append(low if low == high else (1 - share) * low + share * high)
        out[c] = result
    return out


def _order_statistics(values: DataFrame, bracket: dict[tuple[str, int], tuple[float, float]],
                      ends: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The r-th smallest value (0-based) of each (column, r), from a likely bracket of its value."""
    done: dict[tuple[str, int], float] = {}
    bracket = dict(bracket)
    while open_ := [k for k in bracket if k not in done]:
        sizes = _bracket_sizes(values, open_, bracket)
        ready = []
        for k in open_:
            below, inside, distinct = sizes[k]
            low, high = bracket[k]
            if k[1] < below:  # the bracket missed the rank: go on beside it
                bracket[k] = (ends[k[0]][0], _next(low, -1))
            elif k[1] >= below + inside:
                bracket[k] = (_next(high, 1), ends[k[0]][1])
            elif low == high:
                done[k] = low
            elif distinct <= MAX_BRACKET:
                ready.append(k)
        if ready:
            done |= _pick(values, ready, bracket, sizes)
        wide = [k for k in open_ if k not in done and sizes[k][0] <= k[1] < sizes[k][0] + sizes[k][1]]
        if wide:
            bracket |= _narrow(values, wide, bracket, sizes)
    return done


def _bits(x: float) -> int:
    """A whole number in the order of the doubles, the infinite ones included."""
    n = struct.unpack("<q", struct.pack("<d", x))[0]
    return n if n >= 0 else -(n & (1 << 63) - 1)


def _of_bits(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


def _next(x: float, by: int) -> float:
    return _of_bits(_bits(x) + by)


def _inside(key: tuple[str, int], bracket: dict) -> F.Column:
    low, high = bracket[key]
    return F.when(F.col(key[0]).between(low, high), F.col(key[0]))


def _bracket_sizes(values: DataFrame, keys: list, bracket: dict) -> dict:
    """Per key: values below the bracket, values inside, distinct values inside (estimate)."""
    parts = []
    for i, k in enumerate(keys):
        parts += [F.count_if(F.col(k[0]) < bracket[k][0]).alias(f"below{i}"),
                  F.count(_inside(k, bracket)).alias(f"in{i}"),
                  F.approx_count_distinct(_inside(k, bracket)).alias(f"distinct{i}")]
    row = values.agg(*parts).first()
    return {k: (row[f"below{i}"], row[f"in{i}"], row[f"distinct{i}"]) for i, k in enumerate(keys)}


def _pick(values: DataFrame, keys: list, bracket: dict, sizes: dict) -> dict:
    """Exact order statistic inside a bracket with few distinct values."""
    parts = []
    for i, k in enumerate(keys):
        below, inside, _ = sizes[k]
        level = (k[1] - below + 0.5) / inside
        low, high = bracket[k]
        parts.append(F.expr(
            f"percentile_disc({level!r}D) within group (order by case when `{k[0]}` between {number(low)} and {number(high)} "
            f"then `{k[0]}` end)").alias(f"v{i}"))
    row = values.agg(*parts).first()
    return {k: float(row[f"v{i}"]) for i, k in enumerate(keys)}


def _narrow(values: DataFrame, keys: list, bracket: dict, sizes: dict) -> dict:
    """A narrower bracket around the wanted rank: approximate quantiles of what lies inside, halved if they don't narrow it.

    The quantiles only propose; the next count shows if the rank fell outside.
    """
    parts = []
    for i, k in enumerate(keys):
        below, inside, _ = sizes[k]
        level = (k[1] - below + 0.5) / inside
        near = [min(1.0, max(0.0, level + d)) for d in (-_SLACK, _SLACK)]
        parts.append(F.percentile_approx(_inside(k, bracket), near, _ACCURACY).alias(f"e{i}"))
    row = values.agg(*parts).first()
    out = {}
    for i, k in enumerate(keys):
        out[k] = (float(row[f"e{i}"][0]), float(row[f"e{i}"][1]))
        if out[k] == bracket[k]:
            out[k] = (bracket[k][0], _of_bits((_bits(bracket[k][0]) + _bits(bracket[k][1])) // 2))
    return out
