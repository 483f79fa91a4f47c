"""Training jobs: tournament, holdout training, evaluation and comparison of algorithms."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.operators import metrics as E
from fingerloom.operators import models as M
from fingerloom.operators.cleaning import clean_timing
from fingerloom.operators.extract import filter_user, merge_history
from fingerloom.operators.quality import check_features, check_labels, label_counts
from fingerloom.operators.split import stratified_folds, stratified_split
from fingerloom.schema import CV_FOLDS, FEATURES, MIN_PERSONAL_ROWS, TARGET
from fingerloom.session import discard
from fingerloom.sources import registry as R

_ROW = "_row_key"


@dataclass(frozen=True)
class Tournament:
    """Outcome of one tournament; the tables are small except the out-of-fold predictions."""

    winner: str
    leaderboard: DataFrame
    predictions: DataFrame
    model: PipelineModel
    classes: list[str]
    rows: int
    importances: list[tuple[str, float, int]]


def prepare(df: DataFrame, *, dedupe: bool = True, clean: bool = True, context: str = "Dataset",
            min_class_rows: int = 2) -> DataFrame:
    """Deduplicated, cleaned and validated rows, stored with a key that identifies the row.

    Copies are removed over all columns, and the input is read once: what cleaning scans again is a stored table of the columns that a
    fit needs. The key is a hash of the row's values; it only orders rows, so rows that share a key are interchangeable.
    """
    if TARGET not in df.columns:
        raise ValueError(f"{context}: no column {TARGET} to learn from.")
    rows = df.dropDuplicates() if dedupe else df
    present = [c for c in FEATURES if c in rows.columns]
    unclean = M.materialized(rows.withColumn(_ROW, F.xxhash64(*sorted(rows.columns))).select(_ROW, TARGET, *present), "unclean")
    rows = M.training_frame(clean_timing(unclean) if clean else unclean, keep=[_ROW])
    discard(unclean)
    if rows.isEmpty():
        raise ValueError(f"{context}: cleaning left no rows.")
    return check_labels(check_features(rows, context=context), context=context, min_class_rows=min_class_rows)


def _check_folds(rows: DataFrame, folds: int) -> None:
    counts = {r[TARGET]: r["n_rows"] for r in label_counts(rows).collect()}
    if min(counts.values()) < folds:
        raise ValueError(f"{folds} folds need {folds} rows of every class; there are {counts}.")


def run_tournament(df: DataFrame, algorithms: Sequence[str] = M.ALGORITHMS, *, user_id: str | None = None,
                   folds: int = CV_FOLDS, seed: int = 42, context: str = "Training data") -> Tournament:
    """Cross-validate all candidates side by side on one prepared frame; refit the winner on all rows.

    Metrics are those of the pooled out-of-fold predictions; the time of a candidate covers its
    cross-validation.
    """
    names = M.parse_algorithms(algorithms)
    rows = prepare(filter_user(df, user_id), context=context)
    _check_folds(rows, folds)
    spark = df.sparkSession
    folded = M.training_frame(stratified_folds(rows, TARGET, _ROW, folds=folds, seed=seed), keep=[_ROW, "fold"])
    classes = M.label_classes(folded)

    def candidate(position: int, name: str):
        started = time.perf_counter()
        out, whole = M.cross_val_predict(name, folded, classes, folds=folds, key=_ROW, seed=seed)
        stored = M.materialized(out.select(_ROW, TARGET, "prediction"), "predictions")
        took = (time.perf_counter() - started) * 1000.0
        row = E.macro_metrics(stored, TARGET, "prediction").first().asDict()
        return {"algorithm": name, "position": position, **row, "execution_time_ms": took}, stored, whole

    results = M.in_threads([lambda i=i, n=n: candidate(i, n) for i, n in enumerate(names)], workers=len(names))
    columns = ["algorithm", "position", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1",
               "support", "execution_time_ms"]
    board = spark.createDataFrame(
        [tuple(r[c] for c in columns) for r, _, _ in results],
        "algorithm string, position int, accuracy double, macro_precision double, macro_recall double, macro_f1 double, "
        "weighted_f1 double, support bigint, execution_time_ms double")
    winner = E.choose_winner(board).first()["algorithm"]
    _, predictions, model = results[names.index(winner)]
    model = model or M.fit_pipeline(winner, folded, classes, seed=seed)
    return Tournament(winner, board, predictions, model, classes, folded.count(), M.importances(model))


def explain(result: Tournament) -> DataFrame:
    """One row: nested confusion matrix cells and the ten most important features of the winner."""
    spark = result.leaderboard.sparkSession
    cells = E.state_confusion_matrix(result.predictions, TARGET, "prediction").agg(F.array_sort(F.collect_list(
        F.struct("true_label", "predicted_label", "n_rows"))).alias("confusion_matrix"))
    scores = spark.createDataFrame(result.importances, "feature string, importance double, position int")
    ranked = [(r["feature"], r["importance"]) for r in E.top_features(scores).collect()]
    literal = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in ranked])
    return cells.select("confusion_matrix", literal.alias("feature_importances"))


def tournament_report(result: Tournament, *, run_id: str, status: str, dry_run: bool = True, seed: int = 42,
                      model_path: str | None = None) -> DataFrame:
    """The run report row of a tournament."""
    order = F.array_sort(F.collect_list(F.struct(
        "position", F.struct("algorithm", "accuracy", "macro_precision", "macro_recall", "macro_f1", "execution_time_ms").alias("e"))))
    board = result.leaderboard.agg(F.transform(order, lambda x: x["e"]).alias("evaluation_results"))
    sentence = E.primary_misclassification(result.predictions, TARGET, "prediction").first()["summary"]
    top = max(result.importances, key=lambda x: (x[1], -x[2]))[0]
    return board.select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(dry_run).alias("is_dry_run"),
        F.lit(seed).alias("random_state"), F.lit(TARGET).alias("target_column"),
        F.lit(result.winner).alias("champion_model"), F.lit(top).alias("top_predictive_feature"),
        F.lit(sentence).alias("primary_misclassification"), F.lit(result.rows).cast("bigint").alias("total_rows_processed"),
        "evaluation_results", F.lit(model_path).cast("string").alias("model_path"),
        F.current_timestamp().alias("report_created_at"))


def train_global(df: DataFrame, root: str, algorithms: Sequence[str] = M.ALGORITHMS, *, seed: int = 42) -> tuple[Tournament, str]:
    """Tournament on all rows; the winner is stored as the global model."""
    result = run_tournament(df, algorithms, seed=seed)
    return result, _save(df, result, root, None)


def train_personal(history: DataFrame | None, user_id: str, root: str, *, inline: DataFrame | None = None,
                   algorithms: Sequence[str] = M.ALGORITHMS, min_rows: int = MIN_PERSONAL_ROWS,
                   seed: int = 42) -> tuple[Tournament, str]:
    """Tournament on one user's stored and inline rows; stored under the user's model key."""
    rows = filter_user(merge_history(history, inline), user_id)
    if rows.limit(min_rows).count() < min_rows:
        raise ValueError("Insufficient data")
    result = run_tournament(rows, algorithms, seed=seed)
    return result, _save(rows, result, root, user_id)


def _save(df: DataFrame, result: Tournament, root: str, user: str | None) -> str:
    scope, key = R.key_of(df.sparkSession, user)
    return R.save_model(df.sparkSession, result.model, root, scope=scope, key=key, algorithm=result.winner, features=FEATURES,
                        classes=result.classes)


@dataclass(frozen=True)
class Holdout:
    """A model fitted on the train part, and its report on the test part."""

    algorithm: str
    model: PipelineModel
    classes: list[str]
    report: DataFrame
    rows: int
    split: R.Split


def fit_holdout(df: DataFrame, algorithm: str, *, seed: int = 42, test_share: float = 0.2, clean: bool = True,
                dedupe: bool = False) -> Holdout:
    """Clean, validate, split, fit and report."""
    rows = prepare(df, dedupe=dedupe, clean=clean)
    split = M.training_frame(stratified_split(rows, TARGET, _ROW, test_share=test_share, seed=seed), keep=[_ROW, "is_test"])
    classes = M.label_classes(split)
    model = M.fit_pipeline(algorithm, split.where("is_test = 0"), classes, seed=seed)
    scored = M.score(split.where("is_test = 1"), model, classes)
    report = E.classification_report(M.materialized(scored.select(TARGET, "prediction"), "scored"), TARGET, "prediction")
    return Holdout(algorithm, model, classes, report, split.count(), R.Split(seed, test_share, clean, dedupe))


def save_holdout(spark, fitted: Holdout, root: str, *, user: str | None = None, lineage: str = "production",
                 promote: bool = True, token: str | None = None, owner: tuple[str, str] | None = None, saved: str | None = None) -> str:
    """Store a fitted model with its split; a repeated ``token`` stores nothing more. ``owner`` is the user's scope and key, if they are
    known, and ``saved`` a folder that holds the model already."""
    scope, key = owner or R.key_of(spark, user)
    return R.save_model(spark, fitted.model, root, scope=scope, key=key, algorithm=fitted.algorithm, features=FEATURES,
                        classes=fitted.classes, lineage=lineage, promote=promote, token=token, split=fitted.split, saved=saved)


def train_holdout(df: DataFrame, algorithm: str, root: str, *, seed: int = 42, test_share: float = 0.2,
                  clean: bool = True, dedupe: bool = False, user: str | None = None, lineage: str = "production",
                  promote: bool = True) -> tuple[DataFrame, str]:
    """:func:`fit_holdout` and store; returns the report on the test part and the model path."""
    fitted = fit_holdout(df, algorithm, seed=seed, test_share=test_share, clean=clean, dedupe=dedupe)
    return fitted.report, save_holdout(df.sparkSession, fitted, root, user=user, lineage=lineage, promote=promote)


def evaluate_model(df: DataFrame, root: str, user: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Report and confusion matrix of a stored model on the test part of the split it was trained by.

    The registry row says how the rows were prepared and split. A model fitted to all rows, as a tournament stores, has no rows left
    to be judged by, which is an error.
    """
    model, row = R.load_model(df.sparkSession, root, user)
    if not row["feature_names"]:
        raise ValueError("The registry row lists no features, so the model cannot be applied.")
    if row["split_seed"] is None:
        raise ValueError("The model was fitted to all rows; none were held out to judge it by.")
    rows = prepare(df, dedupe=row["deduplicated"], clean=row["cleaned"])
    test = stratified_split(rows, TARGET, _ROW, test_share=row["test_share"], seed=row["split_seed"]).where("is_test = 1")
    scored = M.materialized(M.score(test, model, row["label_classes"]).select(TARGET, "prediction"), "scored")
    return E.classification_report(scored, TARGET, "prediction"), E.confusion_matrix(scored, TARGET, "prediction")


def compare_algorithms(df: DataFrame, root: str, algorithms: Sequence[str] = M.ALGORITHMS, *, seed: int = 42,
                       latency_runs: int = 50) -> DataFrame:
    """One row per algorithm: quality and efficiency on one shared split, or the error that stopped it.

    Ranked rows carry ``quality_rank``, ``quality_ties`` and ``is_best_by_efficiency``.
    """
    names = M.parse_algorithms(algorithms)
    rows = prepare(df, dedupe=False)
    split = M.training_frame(stratified_split(rows, TARGET, _ROW, seed=seed), keep=[_ROW, "is_test"])
    classes = M.label_classes(split)
    test = split.where("is_test = 1").persist()
    out = []
    for position, name in enumerate(names):
        row = {"position": position, "algorithm": name}
        try:
            model = M.fit_pipeline(name, split.where("is_test = 0"), classes, seed=seed)
            path = R.save_model(df.sparkSession, model, root, key="compare", scope="comparison", algorithm=name, features=FEATURES, classes=classes, promote=False)
            scored = M.score(test, model, classes)
            row |= E.macro_metrics(scored, TARGET, "prediction").first().asDict()
            row |= {"status": "ok", "predict_ms": M.predict_ms(test, model, classes, runs=latency_runs),
                    "model_bytes": R.artifact_bytes(df.sparkSession, path)}
        except Exception as ex:  # noqa: BLE001 - a failing candidate is a result row
            row |= {"status": "failed", "error": str(ex)}
        out.append(row)
    test.unpersist()
    schema = ("position int, algorithm string, status string, error string, accuracy double, macro_precision double, "
              "macro_recall double, macro_f1 double, weighted_f1 double, support bigint, predict_ms double, model_bytes bigint")
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]
    board = df.sparkSession.createDataFrame([tuple(r.get(c) for c in columns) for r in out], schema)
    ranked = E.quality_rank(board.where("status = 'ok'"))
    fastest = E.best_by_efficiency(board.where("status = 'ok'")).select("position", F.lit(1).alias("_fast"))
    ranked = ranked.join(fastest, "position", "left").withColumn("is_best_by_efficiency", F.coalesce("_fast", F.lit(0))).drop("_fast")
    return ranked.unionByName(board.where("status <> 'ok'"), allowMissingColumns=True)
