from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fingerloom.operators import extract as X
from fingerloom.plans.extraction import join_feature_session_bucketed
from fingerloom.sources import layout as Ly
from fingerloom.sources.bridge import feature_table, typing_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_bucket_is_read(spark, tmp_path):
    rows = spark.range(5000).selectExpr("concat(' User-', id % 100, ' ') AS user_id", "id AS x")
    stored = Ly.save_sessions_by_user(rows, "by_user", f"file:{tmp_path}/t", buckets=16)
    found = X.filter_user(stored, "USER-7")
    assert sorted(r.x for r in found.collect()) == list(range(7, 5000, 100))
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().get("numOutputRows").get().value()
    assert 50 <= read < 5000 / 4, read
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says how many buckets it reads
    try:
        details = X.filter_user(stored, "USER-7")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: 1 out of 16", details)
    with pytest.raises(ValueError, match="No rows found"):
        X.filter_user(stored, "nobody")


def test_bucketed_join_shuffles_nothing(spark, sf, no_broadcast):
    df = join_feature_session_bucketed(spark, sf)
    text = plan(df)
    assert "SortMergeJoin" in text and "Exchange" not in text
    plain = X.join_feature_session(feature_table(spark, sf), typing_table(spark, sf))
    assert "Exchange" in plan(plain) and df.count() == plain.count()


def table(spark):
    return spark.range(400).select("id", F.when(F.col("id") % 40 == 0, 1).when(F.col("id") % 3 == 0, None).otherwise(0).cast("int").alias("IsOutlier"), F.lit("x").alias("other"))


def test_merge_rewrites_only_what_changes(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    first = Ly.create_versioned(table(spark), root, "id", parts=32)
    with pytest.raises(ValueError, match="already"):
        Ly.create_versioned(table(spark), root, "id")
    ids = spark.createDataFrame([("5",), ("5",), ("6",), ("9999",)], "session_feature_id string")
    second = Ly.merge_outlier_flags(spark, root, ids, clear_existing=False)
    moved = [p for p in first.parts if first.parts[p] != second.parts[p]]
    assert second.number == 1 and 1 <= len(moved) <= 2
    flags = lambda v=None: {r.id: r.IsOutlier for r in Ly.read_versioned(spark, root, v).collect()}
    before = {r.id: r.IsOutlier for r in table(spark).collect()}
    assert flags(first) == before and flags() == before | {5: 1, 6: 1}
    assert Ly.merge_outlier_flags(spark, root, ids, clear_existing=False).number == 1
    # Cleared: all flags of others go, and the old version still reads as it was.
    third = Ly.merge_outlier_flags(spark, root, ids)
    assert flags() == {i: int(i in (5, 6)) for i in before} and third.number == 2
    assert Ly.merge_outlier_flags(spark, root, ids).number == 2
    assert flags(first) == before and Ly.read_versioned(spark, root).columns == ["id", "IsOutlier", "other"]


def test_of_two_merges_one_wins(spark, tmp_path, monkeypatch):
    root = f"file:{tmp_path}/t"
    first = Ly.create_versioned(table(spark), root, "id", parts=8)
    Ly.merge_outlier_flags(spark, root, spark.createDataFrame([("7",)], "i string"), clear_existing=False)
    with monkeypatch.context() as m:
        m.setattr(Ly, "current_version", lambda *a: first)
        with pytest.raises(RuntimeError, match="call again"):
            Ly.merge_outlier_flags(spark, root, spark.createDataFrame([("8",)], "i string"), clear_existing=False)
    Ly.merge_outlier_flags(spark, root, spark.createDataFrame([("8",)], "i string"), clear_existing=False)
    assert {r.id for r in Ly.read_versioned(spark, root).where("IsOutlier = 1").collect()} == {7, 8} | set(range(0, 400, 40))


def test_empty_table_and_no_ids(spark, tmp_path):
    root = f"file:{tmp_path}/t"
    Ly.create_versioned(table(spark).limit(0), root, "id")
    assert Ly.read_versioned(spark, root).count() == 0
    assert Ly.merge_outlier_flags(spark, root, spark.createDataFrame([], "i string")).number == 0
    with pytest.raises(FileNotFoundError):
        Ly.current_version(spark, f"file:{tmp_path}/none")
