from __future__ import annotations

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from fingerloom.operators.generate import expand, generate_sessions, numbered_users, chunk_rows, task_chunks
from fingerloom.operators.ordering import with_group_rank, with_sequence
from fingerloom.operators.split import carry_forward, stratified_folds, stratified_split


def rows(spark, n=1000):
    """Two thirds of the rows share one group, a third share one time stamp; one group is NULL."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 31 % n).alias("t"),
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"))


def test_sequence_equals_window(spark):
    df = rows(spark)
    got = {r["id"]: r["seq"] for r in with_sequence(df, ["t", "id"]).collect()}
    want = {r["id"]: r["n"] for r in df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("n")).collect()}
    assert got == want


def test_group_rank_equals_window(spark):
    df = rows(spark)
    got = {r["id"]: r["rank"] for r in with_group_rank(df, "g", ["t", "id"]).collect()}
    want = {r["id"]: r["n"] for r in df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")).alias("n")).collect()}
    assert got == want


def test_folds_balanced_and_stable(spark):
    results = []
    for n in (1, 4, 16):
        folded = stratified_folds(rows(spark).repartition(n), "g", "id").collect()
        assert len(folded) == 1000
        results.append({r["id"]: r["fold"] for r in folded})
        sizes = Counter((r["g"], r["fold"]) for r in folded)
        for g in {r["g"] for r in folded}:
            per_fold = [sizes[g, k] for k in range(5)]
            assert max(per_fold) - min(per_fold) <= 1
    assert results[0] == results[1] == results[2]


def test_split_shares(spark):
    split = stratified_split(rows(spark), "g", "id").collect()
    assert len(split) == len({r["id"] for r in split}) == 1000
    for g, n in Counter(r["g"] for r in split).items():
        assert sum(r["is_test"] for r in split if r["g"] == g) == -(-n // 5)


def test_carry_forward_over_blocks(spark):
    df = spark.range(300).select(
        F.when(F.col("id") < 200, "u").otherwise("v").alias("user"), (F.col("id") % 200).alias("i"),
        F.when(F.col("id") % 23 == 5, F.col("id").cast("string")).alias("x"))
    got = {(r["user"], r["i"]): r["x"] for r in carry_forward(df, "user", "i", "x", block=16).collect()}
    w = Window.partitionBy("user").orderBy("i")
    want = {(r["user"], r["i"]): r["y"] for r in df.withColumn("y", F.last("x", ignorenulls=True).over(w)).collect()}
    assert got == want


def test_expand_splits_large_counts(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1234)], "k string, n int")
    got = expand(df, F.col("n"), "k", "i", block=100).collect()
    assert Counter(r["k"] for r in got) == {"b": 1, "c": 1234}
    assert sorted(r["i"] for r in got if r["k"] == "c") == list(range(1234))


def test_generated_sessions(spark):
    first = generate_sessions(numbered_users(spark, 10), 12)
    again = generate_sessions(numbered_users(spark, 10).repartition(7), 12)
    assert first.exceptAll(again).isEmpty() and first.count() == 120
    bad = first.where(~F.col("wpm").between(15, 145) | ~F.col("accuracy").between(0.68, 0.997) | ~F.col("dwell_left_ring").between(40, 300))
    assert bad.isEmpty() and first.select("session_id").distinct().count() == 120


def test_chunks(spark):
    tasks = spark.createDataFrame([("t", 250, True), ("s", 100, False)], "task_id string, sessions bigint, inject_outliers boolean")
    chunks = {(r["task_id"], r["chunk_no"]): r for r in task_chunks(tasks, 100).collect()}
    assert [chunks["t", c]["progress"] for c in range(3)] == [42, 74, 90] and chunks["s", 0]["is_last_chunk"]
    made = chunk_rows(task_chunks(tasks, 100)).collect()
    slow = [r for r in made if r["DwellLeftRing"] == 5000]
    assert len(made) == 350 and {(r["task_id"], r["row_no"] % 10) for r in slow} == {("t", 0)} and len(slow) == 25
