from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fingerloom.operators import cleaning as C
from fingerloom.operators import profile as P
from fingerloom.operators import quality as Q
from fingerloom.operators.quantiles import exact_quantiles

NAN = float("nan")


def timing(spark, rows):
    return spark.createDataFrame(rows, "id int, dwell_a double, flight_a double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_null_and_nan_are_kept(spark):
    df = timing(spark, [(1, None, 100.0), (2, NAN, 100.0), (3, -1.0, 100.0), (4, 2001.0, 100.0), (5, 2000.0, 3000.0),
                        (6, NAN, -0.5), (7, None, 3000.5), (8, None, None)])
    assert ids(C.drop_negative(df)) == [1, 2, 4, 5, 7, 8]
    assert ids(C.drop_over_cap(df)) == [1, 2, 3, 5, 6, 8]


def test_clean_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(100, 10, (400, 2)).round(3)
    data[::17, 0], data[::23, 1], data[::31, 0], data[::29, 1] = np.nan, 5000, -3, np.nan
    df = timing(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(data)])
    keep = ~((data < 0).any(1) | (data[:, 0] > 2000) | (data[:, 1] > 3000))
    q1, q3 = np.nanquantile(data[keep], [0.25, 0.75], axis=0)
    keep &= ~(data > q3 + 1.5 * (q3 - q1)).any(1)
    assert ids(C.clean_timing(df)) == np.flatnonzero(keep).tolist()
    audit = C.cleaning_audit(df).first()
    assert audit["rows_before"] == 400 and audit["rows_after"] == keep.sum()


def test_text_timings_and_no_timings(spark):
    df = spark.createDataFrame([(1, " 5 "), (2, "-1"), (3, "n/a"), (4, "9999")], "id int, dwell_a string")
    assert ids(C.clean_timing(df)) == [1, 3]
    plain = spark.createDataFrame([(1, 2.0)], "id int, wpm double")
    assert C.clean_timing(plain) is plain


def test_two_sided_keeps_null_rows_clean(spark):
    rows = [(i, float(100 + i % 5), 100.0) for i in range(20)] + [(50, 10.0, 100.0), (51, None, 100.0), (52, -4.0, 100.0), (53, 900.0, None)]
    flagged, bounds = C.flag_two_sided(timing(spark, rows), ["dwell_a", "flight_a", "absent"], {"dwell_a": 500.0, "gone": 1.0})
    status = {r["id"]: r["status"] for r in flagged.collect()}
    assert (status[50], status[51], status[52], status[53], status[0]) == ("outlier", "clean", "rejected", "rejected", "clean")
    assert set(bounds) == {"dwell_a", "flight_a"}


@pytest.mark.parametrize("bracket", [40, 100_000])
@pytest.mark.parametrize("kind", ["few", "many", "hot", "tiny", "negative"])
def test_quantiles_are_exact(spark, monkeypatch, kind, bracket):
    """Narrowed brackets give the same numbers, also with one value on a third of the rows."""
    from fingerloom.operators import quantiles

    monkeypatch.setattr(quantiles, "MAX_BRACKET", bracket)
    rnd = random.Random(kind)
    values = {"few": [rnd.randint(0, 5) * 1.0 for _ in range(500)], "many": [rnd.random() for _ in range(3000)],
              "hot": [7.25 if rnd.random() < 0.4 else rnd.gauss(7, 2) for _ in range(3000)], "tiny": [1.0, 2.0, 3.0, 10.0],
              "negative": [-rnd.expovariate(1) for _ in range(2000)]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (NAN,)], "x double").withColumn("y", F.lit(None).cast("double"))
    levels = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["x", "y"], levels)
    assert got["y"] is None
    assert np.allclose(got["x"], np.quantile(values, levels), rtol=1e-13, atol=0)


def test_quantiles_of_infinite_values_and_many_distinct_ones(spark, monkeypatch):
    from fingerloom.operators import quantiles

    inf = float("inf")
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(inf,)] * 5 + [(-inf,)] * 3, "x double")
    for bracket in (1, 100_000):
        monkeypatch.setattr(quantiles, "MAX_BRACKET", bracket)
        assert exact_quantiles(df, ["x"], (0.0, 0.25, 0.5, 0.8, 1.0))["x"] == [-inf, 1.25, 5.5, inf, inf]
    many = spark.range(250_000).selectExpr("if(id % 50 = 0, double('inf'), double(id)) AS x")
    want = np.quantile([float(v) for v in range(250_000) if v % 50] + [1e300] * 5000, (0.25, 0.5, 0.75))
    assert exact_quantiles(many, ["x"], (0.25, 0.5, 0.75))["x"] == pytest.approx(want.tolist(), rel=1e-13)


def test_bounds_do_not_depend_on_partitions(spark):
    df = timing(spark, [(i, float((i * 37) % 101), float((i * 53) % 97)) for i in range(500)])
    results = [C.iqr_bounds(df.repartition(n), ["dwell_a", "flight_a"]) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def test_correlation_with_missing_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (200, 3))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 1, 200)
    x[::7, 2] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {(r["column_x"], r["column_y"]): r["correlation"] for r in P.correlation_matrix(df.repartition(5), ["a", "b", "c"]).collect()}
    there = ~np.isnan(x[:, 2])
    assert math.isclose(got["a", "b"], np.corrcoef(x[:, 0], x[:, 1])[0, 1], rel_tol=1e-9)
    assert math.isclose(got["c", "a"], np.corrcoef(x[there, 0], x[there, 2])[0, 1], rel_tol=1e-7)


def test_histogram_of_one_value(spark):
    bins = P.histogram_bins(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"), "x").collect()
    assert len(bins) == 20 and sum(b["n_rows"] for b in bins) == 2


def test_feature_violations(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("-1",), ("inf",), ("nan",), ("2",)], "accuracy string")
    got = {r["rule"]: r["n_rows"] for r in Q.feature_violations(df, {"accuracy": (0.0, 1.0)}).collect()}
    assert got == {"null_or_non_numeric": 3, "non_finite": 1, "below_min": 1, "above_max": 2}


def test_duplicates_count_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (2, "x")], "session_id int, v string")
    got = {r["scope"]: r["n_duplicates"] for r in P.profile_duplicates(df).collect()}
    assert got == {"rows": 1, "session_id": 2}
