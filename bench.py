"""Time the headline jobs and print one JSON line.

The session dataset is derived and stored once, which counts as ``stage_sessions``. Every query is warmed up once, then
timed.
"""

from __future__ import annotations

import json
import os
import time


from fingerloom.operators import cleaning as C
from fingerloom.operators import extract as X
from fingerloom.operators import metrics as E
from fingerloom.operators import models as M
from fingerloom.operators import personal as P
from fingerloom.operators import profile as Pr
from fingerloom.operators import quality as Q
from fingerloom.operators import scoring as L
from fingerloom.operators import training as T
from fingerloom.plans.evaluation import predictions
from fingerloom.schema import FEATURES, TARGET
from fingerloom.session import build_session, materialized
from fingerloom.sources import registry as R
from fingerloom.sources.bridge import feature_table, session_rows, typing_table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS), spark__driver__memory="20g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    features, typing = feature_table(spark, SF_DIR), typing_table(spark, SF_DIR)
    rows = materialized(session_rows(spark, SF_DIR).select("user_id", "session_id", *FEATURES, TARGET), "bench")
    n_rows = rows.count()
    stage = time.perf_counter() - started

    prepared = T.prepare(rows)
    forest = M.fit_pipeline(M.FOREST, prepared, M.label_classes(prepared))
    classes = M.label_classes(prepared)
    boosted = M.fit_pipeline(M.BOOSTED, prepared, classes)
    logistic = M.fit_pipeline(M.LOGISTIC, prepared, classes)
    model = M.linear_model_row(logistic, L.fit_scaler(prepared), classes, R.GLOBAL_KEY)
    columns = ["scope", "model_key", "classes", "coefficients", "intercepts"]
    personal = P.train_all_users(rows).where("status = 'trained'").select(*columns)
    table = materialized(personal.union(spark.createDataFrame([tuple(model[c] for c in columns)], personal.schema)), "models")

    queries = {
        "training_rows": lambda: noop(X.training_rows(features, typing)),
        "clean_timing_outliers": lambda: noop(C.clean_timing(rows)),
        "dedupe_exact": lambda: noop(rows.dropDuplicates()),
        "correlation_matrix": lambda: noop(Pr.correlation_matrix(rows, FEATURES)),
        "dq_feature_rules": lambda: noop(Q.feature_violations(rows)),
        "classification_report": lambda: noop(E.classification_report(predictions(spark, SF_DIR), TARGET, "dwell_rule")),
        "session_sequence": lambda: noop(X.pending_sequence(features, typing)),
        "score_global_linear": lambda: noop(L.score_with_model(rows, model)),
        "score_forest": lambda: noop(M.score(rows, forest, classes).select("session_id", "prediction", "confidence")),
        "score_boosted": lambda: noop(M.score(rows, boosted, classes).select("session_id", "prediction", "confidence")),
        "score_linear_by_user": lambda: noop(L.score_linear(rows, table)),
        "fit_logistic": lambda: M.fit_pipeline(M.LOGISTIC, prepared, classes),
        "train_personal_all_users": lambda: noop(P.train_all_users(rows)),
    }
    times = {"stage_sessions": round(stage, 3)}  # part of the total
    for name, run in queries.items():
        run()
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)
    # Throughput beyond the fixed cost of a job: the dataset twenty times over.
    many = materialized(rows.selectExpr("explode(sequence(1, 20)) AS copy", "*"), "many")
    wanted = ["session_id", "prediction", "confidence"]
    per_sec = {}
    for name, job in {
        "linear": L.score_with_model(many, model), "linear_by_user": L.score_linear(many, table), "forest": M.score(many, forest, classes), "boosted": M.score(many, boosted, classes),
    }.items():
        noop(job.select(*wanted).limit(1000))
        started = time.perf_counter()
        noop(job.select(*wanted))
        per_sec[name] = round(20 * n_rows / (time.perf_counter() - started))
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "rows": n_rows,
        "rows_scored_per_sec": per_sec,
        "users_trained_per_sec": round(rows.select("user_id").distinct().count() / times["train_personal_all_users"], 1),
    }))


if __name__ == "__main__":
    main()
