from __future__ import annotations

import json

from pyspark.sql import functions as F

from fingerloom.operators.extract import timing_averages
from fingerloom.schema import WIRE_ROW_SCHEMA
from fingerloom.sources.bridge import feature_table
from fingerloom.streaming import requests as Rq
from fingerloom.streaming import tasks as Ta
from fingerloom.streaming import telemetry as Te

ID = "00000000-0000-4000-8000-00000000000{}"


def put(path, name, messages):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"topic": t, "value": v if isinstance(v, str) else json.dumps(v)}) for t, v in messages))


def generation(i, sessions, inject=False):
    return Rq.GENERATION_REQUESTS, {"taskId": ID.format(i), "sessions": sessions, "injectOutliers": inject}


def test_routing_survives_restart(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    put(source, "1.json", [generation(1, 5), (Rq.GENERATION_REQUESTS, "{broken"), generation(2, 0), ("other", {})])
    run = lambda: Rq.route_requests(Rq.read_messages(spark, path=str(source), files_per_batch=1), out, progress).awaitTermination()
    run()
    put(source, "2.json", [generation(3, 7), (Rq.TRAINING_REQUESTS, {"taskId": ID.format(4), "dataType": "fake"})])
    run()
    run()
    assert sorted(r["sessions"] for r in spark.read.parquet(f"{out}/requests").collect()) == [5, 7]
    problems = sorted(r["problem"] for r in spark.read.parquet(f"{out}/quarantine").collect())
    assert len(problems) == 4 and problems[-1] == "unsupported topic"


def test_generation_roundtrip_and_state(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [generation(1, 25, True), generation(1, 25, True)])
    put(source, "2.json", [generation(2, 10)])
    Te.stream_generation(Rq.read_messages(spark, path=str(source), files_per_batch=1), out, str(tmp_path / "p1"), chunk_rows=10).awaitTermination()
    chunks = Rq.read_messages(spark, path=f"{out}/{Rq.TELEMETRY_STREAM}", files_per_batch=1)
    Te.stream_explode_chunks(chunks, out, str(tmp_path / "p2")).awaitTermination()
    rows = spark.read.parquet(f"{out}/telemetry")
    assert {r["task_id"]: r["count"] for r in rows.groupBy("task_id").count().collect()} == {ID.format(1): 25, ID.format(2): 10}
    assert rows.where("DwellLeftRing = 5000").count() == 2

    events = spark.readStream.schema(Ta.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/events")
    Ta.stream_task_state(events, out, str(tmp_path / "p3")).awaitTermination()
    failed = [(ID.format(2), 99, "Failed", 0, None, None, "boom")]
    spark.createDataFrame(failed, Ta.EVENT_SCHEMA).write.parquet(f"{out}/events/batch_id=9")
    Ta.stream_task_state(events, out, str(tmp_path / "p3")).awaitTermination()
    state = {r["task_id"]: r for r in Ta.current_state(spark, out).collect()}
    assert (state[ID.format(1)]["progress"], state[ID.format(1)]["processed_sessions"]) == (90, 25)
    assert (state[ID.format(2)]["status"], state[ID.format(2)]["total_sessions"], state[ID.format(2)]["error_message"]) == ("Failed", 10, "boom")
    batch = {r["task_id"]: r for r in Ta.task_state(spark.read.schema(Ta.EVENT_SCHEMA).parquet(f"{out}/events")).collect()}
    assert all(batch[t].asDict() == state[t].asDict() for t in batch)


def test_chunk_contract(spark):
    row = {f.name: 1 for f in WIRE_ROW_SCHEMA}
    good = {"taskId": "t", "isLastChunk": True, "data": [row, row]}
    lacking = {k: v for k, v in row.items() if k != "WPM"}
    bad = [{**good, "data": [row | {"Extra": 1}]}, {**good, "data": [lacking]}, {"taskId": "t", "data": [row]}, {**good, "data": [row | {"WPM": "fast"}]}]
    values = [json.dumps(v) for v in [good, *bad]] + ["no json"]
    out = Te.explode_chunks(spark.createDataFrame([("s", v) for v in values], "topic string, value string"))
    assert out.where("problem is null").count() == 2 and out.where("problem is not null").count() == 5


def test_preprocessing_equals_batch(spark, sf, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [(Rq.PREPROCESSING_REQUESTS, {"taskId": ID.format(1)}), (Rq.PREPROCESSING_REQUESTS, {"taskId": ID.format(2)})])
    averages = lambda: timing_averages(feature_table(spark, sf))
    Ta.stream_preprocessing(Rq.read_messages(spark, path=str(source)), averages, out, str(tmp_path / "p")).awaitTermination()
    results = spark.read.parquet(f"{out}/results").collect()
    listed = spark.read.parquet(f"{out}/outliers").groupBy("batch_id").count().collect()
    assert len(results) == 2 and all(r["rows_scanned"] == 1000 and len(r["samples"]) == 10 for r in results)
    assert [r["count"] for r in listed] == [results[0]["outliers"]]
    states = Ta.task_state(spark.read.parquet(f"{out}/events")).collect()
    assert {(r["task_id"], r["status"], r["progress"]) for r in states} == {(ID.format(i), "PreprocessingPublished", 90) for i in (1, 2)}


def test_failed_preprocessing_is_a_state(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [(Rq.PREPROCESSING_REQUESTS, {"taskId": ID.format(1)})])
    empty = lambda: spark.range(0).select(F.lit("x").alias("other"))
    Ta.stream_preprocessing(Rq.read_messages(spark, path=str(source)), empty, out, str(tmp_path / "p")).awaitTermination()
    row = Ta.task_state(spark.read.parquet(f"{out}/events")).first()
    assert (row["status"], row["progress"]) == ("Failed", 0) and row["error_message"]


def test_failed_training_is_a_state(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [(Rq.TRAINING_REQUESTS, {"taskId": ID.format(1), "dataType": "real"})])
    empty = lambda: spark.range(0).select(F.lit(1.0).alias("wpm"))
    Ta.stream_training(Rq.read_messages(spark, path=str(source)), empty, str(tmp_path / "m"), out, str(tmp_path / "p")).awaitTermination()
    row = spark.read.parquet(f"{out}/results").first()
    assert row["status"] == "Failed" and "weakest_finger" in row["error_message"]


def test_a_repeated_training_batch_adds_nothing(spark, tmp_path):
    """The same requests in a batch of the same number, as after a lost checkpoint."""
    from builders import frame, training_rows
    from fingerloom.operators import models as M
    from fingerloom.sources import registry as R

    source, out, root = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "models")
    put(source, "1.json", [(Rq.TRAINING_REQUESTS, {"taskId": ID.format(i), "dataType": "real", "userEmail": "a@b.c"}) for i in (1, 2)])
    for run in ("p1", "p2"):
        Ta.stream_training(Rq.read_messages(spark, path=str(source)), lambda: frame(spark, training_rows()), root, out, str(tmp_path / run), algorithm=M.LOGISTIC).awaitTermination()
    rows = R.read_registry(spark, root).collect()
    assert len(rows) == 2 and len({r.model_path for r in rows}) == 2 and R.stored_artifacts(spark, root).count() == 2
    assert {r.model_path for r in spark.read.parquet(f"{out}/results").collect()} == {r.model_path for r in rows}
    assert all(r.split_seed == 42 and r.cleaned is False and r.promoted_at is None for r in rows)


def test_no_training_request_gives_no_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [generation(1, 5)])
    Ta.stream_training(Rq.read_messages(spark, path=str(source)), lambda: None, str(tmp_path / "models"), out, str(tmp_path / "p")).awaitTermination()
    assert Ta.training_results(spark, out).collect() == []


def test_one_fit_is_saved_once_for_all_its_requests(spark, tmp_path, monkeypatch):
    """Each request has its own files, and they make the same model as the fit; MLlib writes the model a single time."""
    from builders import frame, training_rows
    from fingerloom.operators import models as M
    from fingerloom.sources import registry as R
    from pyspark.ml import PipelineModel

    saves, write = [], PipelineModel.write
    monkeypatch.setattr(PipelineModel, "write", lambda self: saves.append(1) or write(self))
    source, out, root = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "models")
    emails = ["a@b.c", "A@b.c ", "", None, "x y@z"]
    put(source, "1.json", [(Rq.TRAINING_REQUESTS, {"taskId": ID.format(i), "dataType": "real", "userEmail": e}) for i, e in enumerate(emails)])
    Ta.stream_training(Rq.read_messages(spark, path=str(source)), lambda: frame(spark, training_rows()), root, out, str(tmp_path / "p"), algorithm=M.LOGISTIC).awaitTermination()
    rows = R.read_registry(spark, root).collect()
    assert len(saves) == 1 and len({r.model_path for r in rows}) == 5 == R.stored_artifacts(spark, root).count()
    users = ["a@b.c", "A@b.c", "unknown_user", "unknown_user", "x_y@z"]
    assert sorted((r.scope, r.model_key) for r in rows) == sorted(R.key_of(spark, u) for u in users)
    weights = [PipelineModel.load(r.model_path).stages[-1].coefficientMatrix.toArray().tolist() for r in rows]
    assert all(w == weights[0] for w in weights)
