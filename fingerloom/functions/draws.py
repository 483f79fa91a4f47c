"""Deterministic pseudo-random draws.

Every draw is a function of a key and a tag, so a value depends neither on the partitioning nor on
the engine, and a recomputed task yields the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(key: Column, tag: str | Column) -> Column:
    tag = F.lit(":" + tag) if isinstance(tag, str) else F.concat(F.lit(":"), tag)
    return F.md5(F.concat(key.cast("string"), tag))


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def draw_int(key: Column, tag: str | Column, n: int | Column) -> Column:
    """Integer in [0, n)."""
    return _hex(_digest(key, tag), 1, 7) % n


def draw_unit(key: Column, tag: str | Column) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    return _hex(_digest(key, tag), 1, 13) / F.lit(float(2**52))


def draw_uniform(key: Column, tag: str | Column, low: float | Column, high: float | Column) -> Column:
    return F.lit(low) + draw_unit(key, tag) * (F.lit(high) - F.lit(low))


def draw_normal(key: Column, tag: str | Column, mean: float | Column, std: float | Column) -> Column:
    """Normal double by the Box-Muller transform of the two halves of one digest."""
    digest = _digest(key, tag)
    u = (_hex(digest, 1, 13) + 1) / F.lit(float(2**52 + 1))
    v = _hex(digest, 14, 13) / F.lit(float(2**52))
    return F.lit(mean) + F.lit(std) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def order_hash(key: Column, seed: int | str) -> Column:
    """Hex digest that orders rows in a seeded pseudo-random way."""
    return _digest(key, f"seed{seed}")
