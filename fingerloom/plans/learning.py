"""Registered queries: model training, cross-validation, comparison and scoring.

What a fitted model says depends on MLlib and has no SQL counterpart; counts and statuses have. The tournament runs once per
application and data folder, and the queries about it share its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.operators import extract as X
from fingerloom.operators import metrics as E
from fingerloom.operators import models as M
from fingerloom.operators import personal as P
from fingerloom.operators import scoring as L
from fingerloom.operators import split as Sp
from fingerloom.operators import training as T
from fingerloom.operators.cleaning import drop_negative
from fingerloom.plans import oracle as O
from fingerloom.plans.catalog import query, rounded
from fingerloom.schema import FEATURES, TARGET
from fingerloom.session import scratch_path
from fingerloom.sources import registry as R
from fingerloom.sources import tables as Tb
from fingerloom.sources.bridge import feature_table, session_rows, typing_table

_CACHE: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def dataset(spark, sf) -> DataFrame:
    return session_rows(spark, sf).select("user_id", "session_id", "cohort", *FEATURES, TARGET)


def _split(spark, sf):
    """Cleaned, validated rows with the train / test flag, and the classes."""
    def make():
        rows = T.prepare(dataset(spark, sf))
        frame = M.training_frame(Sp.stratified_split(rows, TARGET, T._ROW), keep=[T._ROW, "is_test"])
        return frame, M.label_classes(frame)
    return _once(spark, sf, "split", make)


def _fitted(spark, sf, algorithm):
    frame, classes = _split(spark, sf)
    return _once(spark, sf, algorithm, lambda: M.fit_pipeline(algorithm, frame.where("is_test = 0"), classes))


def _report(spark, sf, algorithm):
    frame, classes = _split(spark, sf)
    scored = M.score(frame.where("is_test = 1"), _fitted(spark, sf, algorithm), classes)
    return rounded(E.classification_report(scored, TARGET, "prediction"))


_HELD = "cast(ceil(0.2::double * count(*)) as bigint)"  # held-out rows of a class
_NAMES = "(values ('logistic_regression', 0), ('random_forest', 1), ('gradient_boosted', 2)) c(algorithm, position)"


def _labels_of(report: DataFrame) -> DataFrame:
    return report.where(~F.col("label").isin("accuracy", "macro avg", "weighted avg"))


@query("fit_support", O.sessions(f"select algorithm, label, support from {_NAMES}, (select weakest_finger as label, {_HELD} as support from cleaned group by 1)", *O.CLEANING))
def fit_support(spark, sf):
    """The held-out rows of each class that each fitted classifier was judged by."""
    parts = [_labels_of(_report(spark, sf, name)).select(F.lit(name).alias("algorithm"), "label", "support") for name in M.ALGORITHMS]
    return parts[0].union(parts[1]).union(parts[2])


@query("fit_logistic")
def fit_logistic(spark, sf):
    return _report(spark, sf, M.LOGISTIC)


@query("fit_forest")
def fit_forest(spark, sf):
    return _report(spark, sf, M.FOREST)


@query("fit_boosted")
def fit_boosted(spark, sf):
    return _report(spark, sf, M.BOOSTED)


@query("tree_importance")
def tree_importance(spark, sf):
    scores = M.importances(_fitted(spark, sf, M.FOREST))
    return rounded(spark.createDataFrame(scores, "feature string, importance double, position int"))


@query("score_batch")
def score_batch(spark, sf):
    """Every session of the dataset, cleaned or not, with the prediction of the forest."""
    _, classes = _split(spark, sf)
    scored = M.score(dataset(spark, sf), _fitted(spark, sf, M.FOREST), classes)
    return rounded(scored.select("session_id", "prediction", "confidence", *[F.col("probabilities")[c].alias(f"p_{c}") for c in classes]))


def _tournament(spark, sf):
    root = scratch_path(spark, "models")
    return _once(spark, sf, "tournament", lambda: (*T.train_global(dataset(spark, sf), root), root))


@query("algorithm_tournament")
def algorithm_tournament(spark, sf):
    return rounded(_tournament(spark, sf)[0].leaderboard)


@query("tournament_support", O.sessions(f"select algorithm, position, (select count(*) from cleaned) as support from {_NAMES}", *O.CLEANING))
def tournament_support(spark, sf):
    """Every candidate was judged by the out-of-fold prediction of every row."""
    return _tournament(spark, sf)[0].leaderboard.select("algorithm", "position", "support")


@query("cross_val_support", O.sessions("select weakest_finger as label, count(*) as n_rows, count(*) as n_predicted from cleaned group by 1", *O.CLEANING))
def cross_val_support(spark, sf):
    """Out-of-fold predictions by class: each row has one, and it is one of the classes."""
    result = _tournament(spark, sf)[0]
    known = F.count_if(F.col("prediction").isin(result.classes))
    return result.predictions.groupBy(F.col(TARGET).alias("label")).agg(F.countDistinct(T._ROW).alias("n_rows"), known.alias("n_predicted"))


@query("train_global_registered", O.sessions("""select 'global' as scope, 'global' as model_key, string_agg(distinct weakest_finger, ',' order by weakest_finger) as label_classes,
  26 as n_features, 1 as is_latest, 1 as is_candidate from cleaned""", *O.CLEANING))
def train_global_registered(spark, sf):
    active = train_global(spark, sf)
    return active.select("scope", "model_key", "label_classes", "n_features", "is_latest", F.col("algorithm").isin(*M.ALGORITHMS).cast("int").alias("is_candidate"))


@query("explain_global_support", O.sessions("select weakest_finger as label, count(*) as support, 10 as n_importances from cleaned group by 1", *O.CLEANING))
def explain_global_support(spark, sf):
    """The rows of the winner's confusion matrix add up to the classes, and ten features are listed."""
    nested = T.explain(_tournament(spark, sf)[0])
    cells = nested.select(F.inline("confusion_matrix"), F.size("feature_importances").alias("n_importances"))
    return cells.groupBy(F.col("true_label").alias("label")).agg(F.sum("n_rows").alias("support"), F.max("n_importances").alias("n_importances"))


@query("run_report_rows", O.sessions("""select run_id, status, (select count(*) from cleaned) as total_rows_processed, 3 as n_candidates, has_model
  from (values ('run-1', 'dry_run', 0), ('run-2', 'success_global_production', 1)) r(run_id, status, has_model)""", *O.CLEANING))
def run_report_rows(spark, sf):
    return sink_run_report(spark, sf).drop("champion_model")


@query("train_global")
def train_global(spark, sf):
    """The active model of the registry after global training."""
    result, path, root = _tournament(spark, sf)
    active = R.active_models(R.read_registry(spark, root), R.stored_artifacts(spark, root))
    return active.select("scope", "model_key", "algorithm", F.array_join("label_classes", ",").alias("label_classes"),
                         F.size("feature_names").alias("n_features"), (F.col("model_path") == path).cast("int").alias("is_latest"))


@query("cross_val_predict")
def cross_val_predict(spark, sf):
    return _tournament(spark, sf)[0].predictions


@query("explain_global")
def explain_global(spark, sf):
    nested = T.explain(_tournament(spark, sf)[0])
    cells = nested.select(F.lit("confusion").alias("part"), F.inline("confusion_matrix")).select(
        "part", F.concat_ws(" -> ", "true_label", "predicted_label").alias("name"), F.col("n_rows").cast("double").alias("value"))
    scores = nested.select(F.lit("importance").alias("part"), F.inline("feature_importances")).select(
        "part", F.col("feature").alias("name"), F.col("importance").alias("value"))
    return rounded(cells.union(scores))


@query("sink_run_report")
def sink_run_report(spark, sf):
    """Two runs appended to the report table and read back."""
    result, path, _ = _tournament(spark, sf)
    table = scratch_path(spark, "reports")
    for run_id, status, dry in (("run-1", "dry_run", True), ("run-2", "success_global_production", False)):
        Tb.write_run_reports(T.tournament_report(result, run_id=run_id, status=status, dry_run=dry, model_path=None if dry else path), table)
    return Tb.read_run_reports(spark, table).select(
        "run_id", "status", "champion_model", "total_rows_processed", F.size("evaluation_results").alias("n_candidates"),
        (F.col("model_path").isNotNull()).cast("int").alias("has_model"))


@query("model_registry_write_read", O.sessions(f"select cast(sum(n) as bigint) as n_rows, cast(sum(n) as bigint) as n_equal from (select {_HELD} as n from cleaned group by weakest_finger)", *O.CLEANING))
def model_registry_write_read(spark, sf):
    """A stored and reloaded model scores the test rows as the fitted one does."""
    root = scratch_path(spark, "models")
    frame, classes = _split(spark, sf)
    model = _fitted(spark, sf, M.LOGISTIC)
    R.save_model(spark, model, root, scope=R.key_of(spark, " User@One ")[0], key=R.key_of(spark, " User@One ")[1], algorithm=M.LOGISTIC, features=FEATURES, classes=classes)
    loaded, row = R.load_model(spark, root, "user@one")
    test = frame.where("is_test = 1")
    before = M.score(test, model, classes).select(T._ROW, F.col("confidence").alias("fitted"))
    after = M.score(test, loaded, row["label_classes"]).select(T._ROW, F.col("confidence").alias("loaded"))
    same = F.abs(F.col("fitted") - F.col("loaded")) < 1e-9
    return before.join(after, T._ROW).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_equal"))


@query("train_personal")
def train_personal(spark, sf):
    """A tournament over one user's stored and inline rows. Single users have too few rows per class
    for five folds, so the event cohort takes the place of the user."""
    rows = dataset(spark, sf).drop("user_id").withColumnRenamed("cohort", "user_id")
    new = F.col("session_id").cast("bigint") % 10 == 0  # a tenth of the sessions comes with the request
    result, _ = _once(spark, sf, "personal", lambda: T.train_personal(rows.where(~new), " Signup ", scratch_path(spark, "models"), inline=rows.where(new)))
    return rounded(result.leaderboard.drop("execution_time_ms"))


_MINE = ("mine as (select * from sessions where lower(trim(cohort)) = 'signup')", O.KEPT.replace("from sessions", "from mine"), O.QUARTILES, O.CLEANED)


@query("train_personal_support", O.sessions(f"select algorithm, position, (select count(*) from cleaned) as support from {_NAMES}", *_MINE))
def train_personal_support(spark, sf):
    """Stored and inline rows of one user, cleaned by that user's own bounds, judge every candidate."""
    return train_personal(spark, sf).select("algorithm", "position", "support")


_PERSONAL = f"""mine as (select *, count(*) over (partition by user_id) as n_rows from sessions),
ready as (select * from mine where n_rows >= 20 and not {O.negative()} and not {O.capped()}),
own_q as (select user_id as u, {", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in O.TIMINGS)} from ready group by 1),
left_over as (select ready.* from ready join own_q on u = user_id where not ({" or ".join(f"coalesce({c} > q3_{c} + 1.5::double*(q3_{c}-q1_{c}), false)" for c in O.TIMINGS)})),
per_class as (select user_id as u, weakest_finger as l, count(*) as n from left_over group by 1, 2),
per_user as (select u, sum(n) as rows, count(*) as k, min(n) as least, string_agg(l, ',' order by l) as ls from per_class group by 1)"""


@query("train_personal_all_users", O.sessions("""select mine.user_id as model_key, any_value(mine.n_rows) as n_rows,
  case when any_value(mine.n_rows) < 20 then 'insufficient_data' when any_value(k) is null then 'no_rows_after_cleaning'
  when any_value(k) < 2 then 'single_class' when any_value(least) < 2 then 'thin_class' else 'trained' end as status,
  cast(any_value(per_user.rows) as bigint) as training_rows, case when any_value(k) >= 2 and any_value(least) >= 2 then any_value(ls) end as classes
  from mine left join per_user on u = mine.user_id group by 1""", _PERSONAL))
def train_personal_all_users(spark, sf):
    models = P.train_all_users(dataset(spark, sf))
    return models.select("model_key", "n_rows", "status", "training_rows", F.array_join("classes", ",").alias("classes"))


@query("train_holdout")
def train_holdout(spark, sf):
    report, _ = T.train_holdout(dataset(spark, sf), M.LOGISTIC, scratch_path(spark, "models"))
    return rounded(report)


@query("train_forest_registry", O.tables(f"""select 'personal' as scope, 'random_forest' as algorithm, 'experiments' as lineage, cast(count(distinct {O.VALID}) as int) as n_classes
  from (select *, {O.INFERRED} as inferred from feature) feature join typing on typing.Id = feature.TypingSessionId where coalesce(IsOutlier,0)=0 and not {O.negative(O.PASCAL[8:])}"""))
def train_forest_registry(spark, sf):
    """Forest on the extracted rows, stored in the folder of its data type. This job does no IQR
    cleaning; negative timings are dropped, because validation stops on them."""
    root = scratch_path(spark, "models")
    rows = drop_negative(X.training_rows(feature_table(spark, sf), typing_table(spark, sf), label_rule="valid"))
    T.train_holdout(rows, M.FOREST, root, clean=False, user="unknown_user", lineage="experiments")
    return R.read_registry(spark, root).select("scope", "algorithm", "lineage", F.size("label_classes").alias("n_classes"))


@query("evaluate_model")
def evaluate_model(spark, sf):
    """Report of a stored model on the rows that were held out when it was trained."""
    root = scratch_path(spark, "models")
    T.train_holdout(dataset(spark, sf), M.LOGISTIC, root)
    report, _ = T.evaluate_model(dataset(spark, sf), root)
    return rounded(report)


@query("evaluate_model_support", O.sessions("""select weakest_finger as label, cast(ceil(0.2::double * count(*)) as bigint) as support
  from cleaned group by 1""", *O.CLEANING))
def evaluate_model_support(spark, sf):
    """Held-out rows of each class."""
    return evaluate_model(spark, sf).where(~F.col("label").isin("accuracy", "macro avg", "weighted avg")).select("label", "support")


def _comparison(spark, sf):
    root = scratch_path(spark, "models")
    return _once(spark, sf, "comparison", lambda: T.compare_algorithms(dataset(spark, sf), root))


@query("compare_algorithms")
def compare_algorithms(spark, sf):
    return rounded(_comparison(spark, sf).select(
        "algorithm", "status", "error", "accuracy", "macro_f1", "weighted_f1", "support", "quality_rank", "quality_ties"))


@query("compare_support", O.sessions(f"select algorithm, 'ok' as status, support from {_NAMES}, (select cast(sum(n) as bigint) as support from (select {_HELD} as n from cleaned group by weakest_finger))", *O.CLEANING))
def compare_support(spark, sf):
    """Every candidate of the comparison ran, on one held-out part."""
    return _comparison(spark, sf).select("algorithm", "status", "support")


@query("efficiency_metrics")
def efficiency_metrics(spark, sf):
    return rounded(_comparison(spark, sf).select("algorithm", "model_bytes", "predict_ms", "support", "is_best_by_efficiency"))


@query("score_personal_models")
def score_personal_models(spark, sf):
    """Sessions scored by their user's trained model, or by the global logistic model."""
    rows = dataset(spark, sf)
    frame, classes = _split(spark, sf)
    train = frame.where("is_test = 0")
    row = M.linear_model_row(_fitted(spark, sf, M.LOGISTIC), L.fit_scaler(train), classes, R.GLOBAL_KEY)
    columns = ["scope", "model_key", "classes", "coefficients", "intercepts"]
    own = P.train_all_users(rows).where("status = 'trained'").select(*columns)
    top = spark.createDataFrame([tuple(row[c] for c in columns)], own.schema)
    scored = L.score_linear(rows, M.materialized(own.union(top), "linear"))
    return rounded(scored.select("session_id", "used_model_key", "is_fallback_used", "prediction", "confidence"))
