"""Synthetic telemetry from hash draws: the same rows on any cluster, and after any retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.functions.draws import draw_int, draw_normal, draw_uniform, draw_unit
from fingerloom.functions.scalars import clip_round
from fingerloom.operators.split import carry_forward
from fingerloom.schema import (
    CHUNK_ROWS, FEATURES, FINGERS, OUTLIER_TIME_MS, TARGET, finger_columns,
)

#: Made rows of a task: some seconds of draws.
TASK_ROWS = 20_000
# Fixed value: share of sessions in which the weak finger is drawn again.
DRIFT = 0.18


def numbered_users(spark: SparkSession, n_users: int) -> DataFrame:
    """Users ``u0001`` .. as a one-column frame."""
    if n_users <= 0:
        raise ValueError(f"n_users must be > 0, got {n_users}")
    return spark.range(1, n_users + 1).select(F.format_string("u%04d", "id").alias("user_id"))


def _dealt(df: DataFrame, made: Column, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into tasks by the number of rows to be ``made`` of them.

    The rows that say how many to make are few, and without a stated number of tasks they end up in one.
    """
    total = df.agg(F.sum(made)).first()[0] or 0
    return df.repartition(max(1, -(-int(total) // TASK_ROWS)), *keys)


def expand(df: DataFrame, count: Column | int, key: str, name: str, *, block: int = 5000) -> DataFrame:
    """Repeat each row ``count`` times with ``name`` = 0, 1, ...

    A row is first split into blocks, which are spread over the cluster, so one row with a huge count
    does not grow in one task.
    """
    n = (count if isinstance(count, Column) else F.lit(count)).cast("bigint")
    blocks = df.withColumn("_n", n).where(F.col("_n") > 0).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))))
    first = F.col("_block") * block
    last = F.least(first + block, F.col("_n")) - 1
    return _dealt(blocks, last - first + 1, key, "_block").withColumn(name, F.explode(F.sequence(first, last))).drop("_n", "_block")


def weak_finger_drift(users: DataFrame, sessions_per_user: int, *, block: int = 10_000) -> DataFrame:
    """(user_id, session_index, weakest_finger): drawn at the start, redrawn with probability 0.18, else kept."""
    rows = expand(users.select("user_id"), sessions_per_user, "user_id", "session_index")
    key = _key("user_id", "session_index")
    redraw = (F.col("session_index") == 0) | (draw_unit(key, "drift") < DRIFT)
    finger = F.get(F.array(*[F.lit(f) for f in FINGERS]), draw_int(key, "finger", len(FINGERS)).cast("int"))
    drawn = rows.withColumn(TARGET, F.when(redraw, finger))
    return carry_forward(drawn, "user_id", "session_index", TARGET, block=block)


def _key(*columns: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def generate_sessions(users: DataFrame, sessions_per_user: int = 20) -> DataFrame:
    """Session rows of every user: personal base levels, a learning trend, noise and a drifting weak
    finger whose error, dwell and flight are raised."""
    if sessions_per_user <= 0:
        raise ValueError(f"sessions_per_user must be > 0, got {sessions_per_user}")
    user, key, n = F.col("user_id"), F.col("_key"), F.col("session_index")
    rows = weak_finger_drift(users, sessions_per_user).withColumn("_key", _key("user_id", "session_index"))
    wpm = _clip(draw_uniform(user, "base_wpm", 28.0, 78.0) + 0.55 * n + draw_normal(key, "wpm", 0.0, 3.2), 15, 145)
    accuracy = _clip(draw_uniform(user, "base_acc", 0.86, 0.97) + 0.0012 * n + draw_normal(key, "acc", 0.0, 0.009), 0.68, 0.997)
    rows = rows.withColumns({
        "_wpm": wpm, "_acc": accuracy,
        "_dwell": draw_uniform(user, "base_dwell", 72.0, 105.0), "_flight": draw_uniform(user, "base_flight", 165.0, 260.0)})
    miss = F.greatest(F.lit(0.0), 1.0 - F.col("_acc"))
    columns: dict[str, Column] = {}
    for f in FINGERS:
        weak = F.col(TARGET) == f
        lift = lambda tag, low, high: F.when(weak, draw_uniform(key, f"{tag}{f}", low, high)).otherwise(0.0)  # noqa: B023, E731
        error = miss * draw_uniform(key, f"er{f}", 0.65, 1.05) + draw_normal(key, f"en{f}", 0.0, 0.002) + lift("el", 0.05, 0.115)
        dwell = F.col("_dwell") + draw_normal(key, f"dn{f}", 0.0, 5.5) + lift("dl", 28.0, 58.0)
        flight = F.col("_flight") - F.col("_wpm") * 0.45 + draw_normal(key, f"fn{f}", 0.0, 11.0) + lift("fl", 65.0, 120.0)
        columns[f"error_{f}"] = F.round(_clip(error, 0, 0.30), 3)
        columns[f"dwell_{f}"] = F.round(_clip(dwell, 40, 300), 1)
        columns[f"flight_{f}"] = F.round(_clip(flight, 50, 500), 1)
    start = F.lit("2025-12-01T09:00:00").cast("timestamp_ntz")
    moment = start + F.make_dt_interval(n.cast("int"), F.lit(0), draw_int(key, "minute", 240).cast("int"))
    return rows.withColumns(columns).select(
        "user_id", F.md5(F.concat(key, F.lit(":session"))).alias("session_id"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.round("_wpm", 1).alias("wpm"), F.round("_acc", 3).alias("accuracy"), *FEATURES[2:], TARGET)


def generate_seed_telemetry(users: DataFrame, rows_per_user: int = 50) -> DataFrame:
    """Seed rows per user; every tenth has two dwell and two flight times of 2500..5000 ms."""
    rows = expand(users.select("user_id"), rows_per_user, "user_id", "_i").withColumn("Sesi", (F.col("_i") + 1).cast("int"))
    rows = rows.withColumn("_key", _key("user_id", "Sesi"))
    key = F.col("_key")
    tenth = F.col("Sesi") % 10 == 0
    picks = {}
    for m in ("dwell", "flight"):
        picks[f"_{m}a"] = draw_int(key, f"{m}pick1", 8)
        picks[f"_{m}b"] = (draw_int(key, f"{m}pick1", 8) + 1 + draw_int(key, f"{m}pick2", 7)) % 8
    rows = rows.withColumns(picks)

    def timing(m: str, i: int, name: str, mean: float, std: float) -> Column:
        slow = lambda tag: (2500 + draw_int(key, tag, 2501)).cast("int")
        return (F.when(tenth & (F.col(f"_{m}a") == i), slow(f"{m}slow1")).when(tenth & (F.col(f"_{m}b") == i), slow(f"{m}slow2"))
                .otherwise(clip_round(draw_normal(key, name, mean, std), 1)).alias(name))

    return rows.select(
        F.col("user_id").alias("UserId"), "Sesi",
        clip_round(draw_normal(key, "WPM", 45.0, 5.0), 1).alias("WPM"),
        F.round(draw_uniform(key, "Accuracy", 0.85, 0.99), 4).alias("Accuracy"),
        *[F.round(draw_uniform(key, c, 0.0, 0.05), 4).alias(c) for c in finger_columns("error", case="pascal")],
        *[timing("dwell", i, c, 100.0, 15.0) for i, c in enumerate(finger_columns("dwell", case="pascal"))],
        *[timing("flight", i, c, 200.0, 30.0) for i, c in enumerate(finger_columns("flight", case="pascal"))])


def progress_percent(processed: Column, total: Column) -> Column:
    """90 once everything is processed, else 10 plus the share of 80, at most 89."""
    share = F.least(F.lit(89), (F.lit(10) + F.floor(processed / total * 80)).cast("int"))
    return F.when(processed >= total, 90).otherwise(share).cast("int")


def task_chunks(tasks: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk of each task (task_id, sessions, inject_outliers): range and progress."""
    sessions, c = F.col("sessions"), F.col("chunk_no")
    blocks = F.ceil(sessions / chunk_rows)
    return expand(tasks, blocks, "task_id", "chunk_no").withColumns({
        "first_row": c * chunk_rows + 1,
        "processed": F.least((c + 1) * chunk_rows, sessions),
    }).withColumns({
        "is_last_chunk": F.col("processed") >= sessions,
        "progress": progress_percent(F.col("processed"), sessions),
    })


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """The telemetry rows of each chunk; with outliers on, every tenth row of a task has only 5000 ms timings."""
    keep = ["task_id", "chunk_no", "is_last_chunk"]
    rows = _dealt(chunks, F.col("processed") - F.col("first_row") + 1, "task_id", "chunk_no").select(
        *keep, "inject_outliers", F.explode(F.sequence("first_row", "processed")).alias("row_no"))
    rows = rows.withColumn("_key", _key("task_id", "row_no"))
    key = F.col("_key")
    slow = F.col("inject_outliers") & (F.col("row_no") % 10 == 0)

    def timing(c: str, mean: float, std: float, low: int, high: int) -> Column:
        return F.when(slow, OUTLIER_TIME_MS).otherwise(clip_round(draw_normal(key, c, mean, std), low, high)).cast("int").alias(c)

    return rows.select(
        *keep, "row_no",
        clip_round(draw_normal(key, "WPM", 48.0, 9.0), 12, 180).alias("WPM"),
        F.round(draw_uniform(key, "Accuracy", 0.86, 0.995), 4).alias("Accuracy"),
        *[F.round(draw_uniform(key, c, 0.0, 0.06), 4).alias(c) for c in finger_columns("error", case="pascal")],
        *[timing(c, 105.0, 18.0, 25, 900) for c in finger_columns("dwell", case="pascal")],
        *[timing(c, 185.0, 28.0, 30, 1200) for c in finger_columns("flight", case="pascal")])


def chunk_messages(tasks: DataFrame, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """One compact JSON envelope per chunk. A chunk holds at most ``rows_per_chunk`` rows, and its rows
    are collected where they were made: the grouping needs no further shuffle."""
    rows = chunk_rows(task_chunks(tasks, rows_per_chunk))
    fields = [c for c in rows.columns if c not in ("task_id", "chunk_no", "is_last_chunk", "row_no")]
    ordered = F.array_sort(F.collect_list(F.struct("row_no", F.struct(*fields).alias("row"))))
    envelopes = rows.groupBy("task_id", "chunk_no", "is_last_chunk").agg(F.transform(ordered, lambda x: x["row"]).alias("data"))
    body = F.to_json(F.struct(F.col("task_id").alias("taskId"), F.col("is_last_chunk").alias("isLastChunk"), "data"))
    return envelopes.select("task_id", "chunk_no", body.alias("value"))
