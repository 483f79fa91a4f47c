"""Typing-session tables derived from the ``events`` table.

The given tables hold no typing data, so one session per event is derived with hash draws of the
event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions import scalars as S
from fingerloom.functions.draws import draw_int
from fingerloom.schema import ERROR_COLUMNS, FINGERS, PASCAL_TO_SNAKE, TARGET, pascal
from fingerloom.session import scratch_path, spread


_STAGED: dict[tuple[str, str], tuple[str, T.StructType]] = {}
#: Events of a task: some seconds of draws.
TASK_ROWS = 100_000


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables side by side, derived once per application and data folder.

    The derived rows are stored in the shared folder, so every query reads a columnar table with
    pruning and pushdown instead of repeating the draws.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
        drawn = spread(events, "event_id", rows=TASK_ROWS).withColumns({"weak": _h("w", 8), "r": _h("n", 100)})
        # Only the weak finger is raised, so its three draws are made once, by its name.
        name = F.get(F.array(*[F.lit(f) for f in FINGERS]), F.col("weak").cast("int"))
        drawn = drawn.withColumns({f"more_{t}": least + draw_int(F.col("event_id"), F.concat(F.lit(t), name), n)
                                   for t, least, n in (("x", 500, 650), ("y", 28, 31), ("z", 65, 56))})
        wide = drawn.select(*_feature_columns(), *_typing_columns())
        path = scratch_path(spark, "typing")
        wide.write.parquet(path)
        _STAGED[key] = path, wide.schema
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)


def _h(tag: str, n: int) -> Column:
    return draw_int(F.col("event_id"), tag, n)


def _feature_columns() -> list[Column]:
    eid, weak, r = F.col("event_id"), F.col("weak"), F.col("r")
    slow = eid % 20 == 0
    error, dwell, flight = [], [], []
    for i, f in enumerate(FINGERS):
        raised = lambda t: F.when(weak == i, F.col(f"more_{t}")).otherwise(0)  # noqa: B023, E731
        # A whole number by 10,000 has four decimals as it is.
        error.append(((_h(f"e{f}", 300) + raised("x")) / 10000.0).alias(f"Error{pascal(f)}"))
        dwell.append(
            F.when(slow, 5000).when(eid % 97 == 0, -5)
            .otherwise(72 + _h(f"d{f}", 34) + raised("y")).cast("int").alias(f"Dwell{pascal(f)}"))
        flight.append(
            F.when(slow, 5000).otherwise(165 + _h(f"f{f}", 96) + raised("z"))
            .cast("int").alias(f"Flight{pascal(f)}"))
    # All draws in one generated method are more than Java compiles; a lambda keeps these columns out of whole-stage code, so they are split.
    own = F.get(F.transform(F.array(eid), lambda x: x), F.lit(0))
    return [
        own.alias("Id"), eid.alias("TypingSessionId"), F.col("ts").alias("CreatedAt"),
        F.when(r < 50, F.lit(None)).when(r < 95, 0).otherwise(1).cast("int").alias("IsOutlier"),
        F.when(r % 3 == 0, 1).otherwise(0).alias("IsUsedForTraining"),
        *error, *dwell, *flight,
    ]


def _typing_columns() -> list[Column]:
    weak, r = F.col("weak"), F.col("r")
    name = F.get(F.array(*[F.lit(f) for f in FINGERS]), weak.cast("int"))
    return [
        F.col("user_id").alias("UserId"), F.col("event_type").alias("Cohort"),
        (28 + _h("wpm", 51)).alias("Wpm"),
        F.when(r < 15, (86 + _h("a", 13)).cast("double"))
        .otherwise((86.0 + _h("a", 13)) / 100.0).alias("Accuracy"),
        F.when(r < 20, F.lit(None)).when(r < 25, "").when(r < 30, "thumb")
        .when(r < 40, F.upper(F.concat(F.lit(" "), name, F.lit(" ")))).otherwise(name).alias("WeakestFinger"),
    ]


_TYPING = ["UserId", "Cohort", "Wpm", "Accuracy", "WeakestFinger"]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows: id, session id, flags and 24 per-finger metrics in Pascal case."""
    return stage(spark, sf_dir).drop(*_TYPING)


def typing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows: id, user, time, speed, accuracy (unit or percent) and the stated, dirty label."""
    return stage(spark, sf_dir).select("Id", "CreatedAt", *_TYPING)


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session dataset: ids, cohort, 26 double features in snake case, resolved label.

    Both sides of a session come from the same event, so it is read without a join.
    """
    return to_sessions(stage(spark, sf_dir))


def to_sessions(joined: DataFrame) -> DataFrame:
    """Snake-case session dataset of joined feature and session rows."""
    errors = dict(zip(FINGERS, ERROR_COLUMNS))
    return joined.select(
        F.col("UserId").cast("string").alias("user_id"),
        F.col("TypingSessionId").cast("string").alias("session_id"),
        F.col("CreatedAt").alias("timestamp"),
        F.col("Cohort").alias("cohort"),
        F.col("WeakestFinger").alias("stated_finger"),
        F.col("Wpm").cast("double").alias("wpm"),
        S.accuracy_to_unit(F.col("Accuracy")).cast("double").alias("accuracy"),
        *[F.expr(f"double({p}) AS {s}") for p, s in PASCAL_TO_SNAKE.items()],
    ).withColumn(
        TARGET, S.label_valid_or_inferred(F.col("stated_finger"), S.weakest_by_max_error(errors))
    )
