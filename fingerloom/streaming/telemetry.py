"""Telemetry chunks: producing them for generation requests, and reading them back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fingerloom.operators import generate as G
from fingerloom.schema import CHUNK_ROWS, CHUNK_SCHEMA, WIRE_ROW_SCHEMA
from fingerloom.streaming.requests import TELEMETRY_STREAM, parse_requests, run_batches, write_batch
from fingerloom.streaming.requests import GENERATION_REQUESTS

#: State updates of a file. Who follows them takes some files at a time, so tiny files are as many micro-batches.
FILE_EVENTS = 100_000


def publish(messages: DataFrame, target: str, batch_id: int, *, servers: str | None = None, topic: str = TELEMETRY_STREAM) -> None:
    """Write JSON messages (column ``value``) of one micro-batch to a Kafka topic or to a table folder."""
    out = messages.select(F.lit(topic).alias("topic"), "value")
    if servers:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        write_batch(out, target, batch_id, format="json")


def generation_events(tasks: DataFrame, chunk_rows: int) -> DataFrame:
    """State updates of generation tasks: the start, then one per chunk."""
    start = tasks.select("task_id", F.lit(0).cast("bigint").alias("event_no"), F.lit("Processing").alias("status"),
                         F.lit(10).alias("progress"), F.col("sessions").alias("total_sessions"),
                         F.lit(0).cast("bigint").alias("processed_sessions"), F.lit(None).cast("string").alias("error_message"))
    chunks = G.task_chunks(tasks, chunk_rows).select(
        "task_id", (F.col("chunk_no") + 1).alias("event_no"), F.lit("Processing").alias("status"), "progress",
        F.col("sessions").alias("total_sessions"), F.col("processed").alias("processed_sessions"),
        F.lit(None).cast("string").alias("error_message"))
    return start.unionByName(chunks)


def stream_generation(messages: DataFrame, out: str, checkpoint: str, *, chunk_rows: int = CHUNK_ROWS,
                      servers: str | None = None, **trigger) -> StreamingQuery:
    """Generation requests to a stream of chunk messages and to state updates.

    A repeated request within a micro-batch is handled once; a repeated batch makes the same rows,
    since they are functions of task and row number.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        tasks = batch.where(F.col("problem").isNull() & (F.col("topic") == GENERATION_REQUESTS)).select(
            "task_id", "sessions", "inject_outliers").dropDuplicates(["task_id"]).persist()
        publish(G.chunk_messages(tasks, chunk_rows), f"{out}/{TELEMETRY_STREAM}", batch_id, servers=servers)
        events = generation_events(tasks, chunk_rows)
        write_batch(events.coalesce(max(1, -(-events.count() // FILE_EVENTS))), f"{out}/events", batch_id)
        tasks.unpersist()

    return run_batches(parse_requests(messages), handle, checkpoint, **trigger)


def explode_chunks(messages: DataFrame) -> DataFrame:
    """Telemetry rows of chunk messages, with ``problem`` for messages that break the contract.

    A row needs all fields and may have no others; a bad message gives one row without telemetry.
    """
    names = [f.name for f in WIRE_ROW_SCHEMA]
    fields = F.array(*[F.lit(n) for n in names])
    loose = "struct<taskId:string,isLastChunk:boolean,data:array<map<string,string>>>"
    parsed = messages.withColumns({"_c": F.from_json("value", CHUNK_SCHEMA), "_keys": F.from_json("value", loose)})
    extra = F.exists("_keys.data", lambda row: F.size(F.array_except(F.map_keys(row), fields)) > 0)
    lacking = F.exists("_c.data", lambda row: F.exists(F.array(*[row[n].isNull() for n in names]), lambda x: x))
    bad = F.coalesce(extra, F.lit(True)) | F.coalesce(lacking, F.lit(True)) | F.col("_c.taskId").isNull() | F.col("_c.isLastChunk").isNull()
    checked = parsed.withColumn("problem", F.when(bad, "malformed chunk"))
    empty = F.array(F.lit(None).cast(WIRE_ROW_SCHEMA))
    return checked.select(
        F.col("_c.taskId").alias("task_id"), F.col("_c.isLastChunk").cast("int").alias("is_last_chunk"), "problem",
        F.explode(F.when(bad, empty).otherwise(F.col("_c.data"))).alias("_r")).select("task_id", "is_last_chunk", "problem", "_r.*")


def stream_explode_chunks(messages: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rows of valid chunks to ``out/telemetry``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.where(F.col("problem").isNull()).drop("problem"), f"{out}/telemetry", batch_id)

    return run_batches(explode_chunks(messages), handle, checkpoint, **trigger)
