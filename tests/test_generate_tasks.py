from __future__ import annotations

from fingerloom.operators import generate as G
from fingerloom.streaming import telemetry as Te
from fingerloom.streaming.requests import GENERATION_REQUESTS


def test_made_rows_decide_the_tasks(spark, monkeypatch):
    """Few users or chunks that are made into many rows are not left to one task."""
    monkeypatch.setattr(G, "TASK_ROWS", 500)
    users = spark.range(200).selectExpr("concat('u', id) AS user_id")
    rows = G.expand(users, 20, "user_id", "i")
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 4000 and rows.dropDuplicates().count() == 4000
    tasks = spark.range(40).selectExpr("concat('t', id) AS task_id", "100L AS sessions", "false AS inject_outliers")
    made = G.chunk_rows(G.task_chunks(tasks, 30)).select("task_id", "row_no")
    assert made.rdd.getNumPartitions() == 8 and made.dropDuplicates().count() == 4000
    assert G.expand(users.limit(0), 20, "user_id", "i").count() == 0


def test_updates_of_a_batch_are_few_files(spark, tmp_path):
    """Readers take some files at a time, so a batch's few updates stand in one."""
    ids = [f"00000000-0000-0000-0000-{i:012d}" for i in range(60)]
    body = "{\"taskId\": \"%s\", \"sessions\": 30, \"injectOutliers\": false}"
    spark.createDataFrame([(GENERATION_REQUESTS, body % i) for i in ids], "topic string, value string").coalesce(1).write.json(f"{tmp_path}/in")
    messages = spark.readStream.schema("topic string, value string").json(f"{tmp_path}/in")
    Te.stream_generation(messages, f"{tmp_path}/out", f"{tmp_path}/progress", chunk_rows=10).awaitTermination()
    events = spark.read.parquet(f"{tmp_path}/out/events")
    assert events.count() == 240 and len(events.inputFiles()) == 1
