from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fingerloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, score string"


def brute(rows, is_anchor, positives=5, negs=3):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**31 for x in v):
            continue
        row = (i, label, tuple(int(x) for x in v))
        if row not in good:
            good.append(row)
    out = []
    for a in good:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b) for b in good if len(b[2]) == len(a[2]) and b != a)
        scored = [(-s, b) for s, b in scored]
        for p, pos in [(s, b) for s, b in scored if b[1] == a[1]][:positives]:
            fits = [(s, b) for s, b in scored if b[1] != a[1] and 50 * p <= 100 * s and 100 * s <= 95 * p][:negs]
            out += [(a[0], pos[0], k + 1, b[0], p, s) for k, (s, b) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


def clustered(n, d, seed, scale=60):
    """Vectors near a few directions, of very unlike length, so that lists end early."""
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(12, d))
    out = []
    for i in range(n):
        v = (ways[rng.integers(12)] + 0.2 * rng.normal(size=d)) * scale * rng.exponential()
        out.append((int(i), [float(int(x)) for x in v], int(rng.integers(4))))
    return out


@pytest.mark.parametrize(("block", "sample", "step"), [(20_000, 10_000, 1024), (17, 40, 16)])
def test_equals_brute_force(spark, monkeypatch, block, sample, step):
    monkeypatch.setattr(negatives, "STEP", step)
    rows = clustered(900, 16, 1)
    rows += [(i, rows[i - 900][1], 1) for i in range(900, 940)] + rows[:30]  # equal vectors and repeated rows
    random.Random(2).shuffle(rows)
    found = negatives.mine(frame(spark, rows).repartition(5), F.col("id") % 10 == 0, block=block, sample=sample)
    assert got(found) == brute(rows, lambda i: i % 10 == 0)


def test_lists_end_early():
    rows = clustered(4000, 16, 3)
    own = negatives.Rows(np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows], np.int64))
    anchors = negatives.Rows(*(x[:100] for x in own))
    block = negatives.Block.of(anchors, negatives.centres(own), negatives._first_thresholds(anchors, [negatives.Rows(*(x[:1000] for x in own))], 5))
    walked = sum(len(part) * len(listed) for part, listed, _ in negatives._steps(block, own, block.least))
    assert walked < 0.7 * 100 * 4000


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 3.0], 1), (1, [2.0, 2.0], 1), (2, [2.0, 1.0], 2), (3, [1.0, 1.0], 2), (4, None, 1), (5, [1.0, 2.0], None), (None, [9.0, 9.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [0.0, 0.0], 1), (11, [], 1), (20, [], 1), (21, [], 2), (12, [2.0**31, 1.0], 1), (13, [1.5e9, 1.5e9], 2),
            (30, [-1.0, -2.0], 1), (31, [0.0, 0.0], 2), (14, [2.0, 1.0], 2), (15, [2.0, 1.0], 2), (16, [2.0, 1.0], 3)]
    found = negatives.mine(frame(spark, rows), F.col("id") % 10 == 0)
    assert got(found) == brute(rows, lambda i: i % 10 == 0)
    assert got(negatives.mine(frame(spark, rows).limit(0), F.col("id") % 10 == 0)) == []
    assert got(negatives.mine(frame(spark, rows), F.col("id") == 99)) == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2**29, 2**29)) for _ in range(4)], i % 2) for i in range(60)]
    assert got(negatives.mine(frame(spark, rows), F.col("id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)
