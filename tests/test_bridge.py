from __future__ import annotations

import hashlib

from fingerloom.schema import FINGERS, pascal
from fingerloom.sources import bridge


def drawn(key, tag, n):
    return int(hashlib.md5(f"{key}:{tag}".encode()).hexdigest()[:7], 16) % n


def test_tasks_are_bounded_and_rows_are_as_drawn(spark, tmp_path, monkeypatch):
    """More rows are more tasks, whatever the number of cores, and the weak finger alone is raised."""
    monkeypatch.setattr(bridge, "TASK_ROWS", 50)
    events = spark.range(1, 1001).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    staged = bridge.stage(spark, str(tmp_path))
    files = staged.inputFiles()
    assert len(files) >= 18  # 20 tasks, of which hashing may leave some empty; the session has 4 cores
    for row in staged.where("Id < 40 OR Id = 97").collect():
        weak = drawn(row.Id, "w", 8)
        for i, f in enumerate(FINGERS):
            raised = i == weak
            assert row[f"Error{pascal(f)}"] == (drawn(row.Id, f"e{f}", 300) + raised * (500 + drawn(row.Id, f"x{f}", 650))) / 10000
            flight = 165 + drawn(row.Id, f"f{f}", 96) + raised * (65 + drawn(row.Id, f"z{f}", 56))
            dwell = 72 + drawn(row.Id, f"d{f}", 34) + raised * (28 + drawn(row.Id, f"y{f}", 31))
            assert row[f"Flight{pascal(f)}"] == (5000 if row.Id % 20 == 0 else flight)
            assert row[f"Dwell{pascal(f)}"] == (5000 if row.Id % 20 == 0 else -5 if row.Id % 97 == 0 else dwell)


def test_wide_draws_are_split_into_methods(spark):
    """All draws in one generated method would be more than Java compiles; the values are those of the draws."""
    wide = spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "5 AS weak", "2 AS r", "1 AS more_x", "2 AS more_y", "3 AS more_z").select(*bridge._feature_columns())
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Project" in line and "md5" in line and "*(" in line]
    assert [(r.Id, r.TypingSessionId) for r in wide.collect()] == [(i, i) for i in range(40)]
