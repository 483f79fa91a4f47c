"""The three candidate classifiers as MLlib pipelines, cross-validation and model tables."""

from __future__ import annotations

import time
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.operators import boosting
from fingerloom.operators.scoring import fit_scaler, label_list
from fingerloom.operators.trees import PackedTrees, packed_forest, with_probabilities
from fingerloom.schema import FEATURES, TARGET
from fingerloom.session import materialized

LOGISTIC, FOREST, BOOSTED = "logistic_regression", "random_forest", "gradient_boosted"
ALGORITHMS = (LOGISTIC, FOREST, BOOSTED)
ROWS_PER_TASK = 10_000
#: Rows that folds are fitted on side by side: a forest keeps some 2 KB of each at hand, and more rows fill the cores by themselves.
SIDE_BY_SIDE_ROWS = 1_000_000


def parse_algorithms(names: str | Sequence[str]) -> list[str]:
    """Requested algorithm names; errors if there are none or one is unknown."""
    wanted = [n.strip() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]
    if not wanted:
        raise ValueError("No candidate algorithms were given.")
    unknown = [n for n in wanted if n not in ALGORITHMS]
    if unknown:
        raise ValueError(f"Unsupported algorithms: {unknown}. Use one of: {list(ALGORITHMS)}")
    return wanted


def label_classes(df: DataFrame, label: str = TARGET) -> list[str]:
    """The sorted labels of ``df``."""
    return label_list(df, label)


def training_frame(df: DataFrame, *, keep: Sequence[str] = (), label: str = TARGET,
                   features: Sequence[str] = FEATURES) -> DataFrame:
    """The columns a fit needs, written once to the shared folder and cut into tasks by row count.

    Iterative fits read it many times: lineage ends at the stored files, and small data does not pay
    for empty tasks.
    """
    stored = materialized(df.select(*keep, label, *features), "training")
    rows = stored.count()
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    if tasks < stored.rdd.getNumPartitions():
        stored = stored.coalesce(tasks)
    return stored


def _classifier(algorithm: str, n_rows: int, n_classes: int, seed: int):
    columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
    if algorithm == LOGISTIC:
        # The summed log loss with an L2 term of 1/2 |w|^2 equals the mean loss with regParam 1/n.
        return LogisticRegression(
            maxIter=2000, tol=1e-8, regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False,
            probabilityCol="_probability", rawPredictionCol="_raw", **columns)
    # Rows remember their node of every tree; otherwise each level walks all rows down all trees from the root.
    return RandomForestClassifier(
        numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed, maxBins=64, cacheNodeIds=True, checkpointInterval=-1,
        probabilityCol="_probability", rawPredictionCol="_raw", maxMemoryInMB=1024, **columns)


def fit_pipeline(algorithm: str, df: DataFrame, classes: Sequence[str], *, label: str = TARGET,
                 features: Sequence[str] = FEATURES, seed: int = 42) -> PipelineModel:
    """A pipeline fitted on ``df``. The linear model has a scaler, a SQL stage with the population moments; trees need none."""
    parse_algorithms([algorithm])
    if algorithm == BOOSTED:
        return PipelineModel([boosting.fit(df, classes, label=label, features=features, settings=boosting.Settings(seed=seed)).model])
    n_rows = df.count()
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features")]
    if algorithm == LOGISTIC:
        scaled = ", ".join(f"(`{c}` - {m!r}D) / {s!r}D AS `_z_{c}`" for c, (m, s) in fit_scaler(df, features).items())
        stages = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_features")]
    prepared = df.withColumn("_label", S.encode_label(F.col(label), classes).cast("double"))
    for stage in stages:
        prepared = stage.transform(prepared)
    prepared = prepared.select("_label", "_features").persist()
    try:
        model = _classifier(algorithm, n_rows, len(classes), seed).fit(prepared)
    finally:
        prepared.unpersist()
    return PipelineModel([*stages, model])


def score(df: DataFrame, model: PipelineModel, classes: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction``, ``confidence`` and ``probabilities``; tree ensembles run as packed node tables."""
    fitted = model.stages[-1]
    if isinstance(fitted, PackedTrees):
        scored, probabilities = fitted.transform(df), F.col("_probability")
    elif isinstance(fitted, RandomForestClassificationModel):
        scored = with_probabilities(df, packed_forest(fitted, df.sparkSession), model.stages[-2].getInputCols())
        probabilities = F.col("_probability")
    else:
        scored, probabilities = model.transform(df), vector_to_array("_probability")
    scored = scored.withColumn("_p", probabilities)
    return scored.withColumn("_out", S.prediction_struct(F.col("_p"), list(classes))).select(
        *df.columns, "_out.prediction", "_out.confidence", "_out.probabilities")


def in_threads(tasks: Sequence, workers: int = 8) -> list:
    """Results of driver calls that each run Spark jobs of their own; errors are raised."""
    with ThreadPool(max(1, min(workers, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda task: task()), tasks)


def cross_val_predict(algorithm: str, folded: DataFrame, classes: Sequence[str], *, folds: int, key: str,
                      label: str = TARGET, features: Sequence[str] = FEATURES, seed: int = 42) -> tuple[DataFrame, PipelineModel | None]:
    """Out-of-fold predictions of every row (``key``, label, prediction), and the fit to all rows if that comes with them.

    Boosting fits all folds and all rows together; the others run one fit per fold, side by side as far as the number of rows allows.
    """
    if algorithm == BOOSTED:
        found = boosting.fit(folded, classes, label=label, features=features, key=key, fold="fold", folds=folds, settings=boosting.Settings(seed=seed))
        return found.out_of_fold.withColumnsRenamed({"key": key, "label": label}), PipelineModel([found.model])

    def one(fold: int):
        train = folded.where(F.col("fold") != fold)
        model = fit_pipeline(algorithm, train, classes, label=label, features=features, seed=seed)
        return score(folded.where(F.col("fold") == fold), model, classes).select(key, label, "prediction")

    workers = max(1, min(folds, SIDE_BY_SIDE_ROWS // max(1, folded.count())))
    parts = in_threads([lambda k=k: one(k) for k in range(folds)], workers=workers)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out, None


def linear_model_row(model: PipelineModel, scaler: dict[str, tuple[float, float]], classes: Sequence[str],
                     key: str, scope: str = "global") -> dict:
    """A fitted logistic pipeline as a row of the model table, with weights moved to raw features."""
    fitted = model.stages[-1]
    weights = fitted.coefficientMatrix.toArray().tolist()
    intercepts = fitted.interceptVector.toArray().tolist()
    if len(classes) == 2:
        weights, intercepts = [[0.0] * len(weights[0]), weights[0]], [0.0, intercepts[0]]
    moments = list(scaler.values())
    raw = [[w / s for w, (_, s) in zip(row, moments)] for row in weights]
    shifted = [b - sum(w * m for w, (m, _) in zip(row, moments)) for row, b in zip(raw, intercepts)]
    return {"scope": scope, "model_key": key, "classes": list(classes), "coefficients": raw, "intercepts": shifted,
            "scales": [s for _, s in moments]}


def importances(model: PipelineModel, features: Sequence[str] = FEATURES) -> list[tuple[str, float, int]]:
    """(feature, importance, position): tree importances, or mean absolute coefficients of the standardised features."""
    fitted = model.stages[-1]
    if isinstance(fitted, PackedTrees):
        values = fitted.getOrDefault(fitted.importance)
    elif hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    return [(f, float(v), i) for i, (f, v) in enumerate(zip(features, values))]


def predict_ms(df: DataFrame, model: PipelineModel, classes: Sequence[str], *, runs: int = 50) -> float:
    """Mean wall time of one prediction pass over ``df`` after a warm-up."""
    if runs <= 0:
        raise ValueError("runs must be greater than zero.")
    job = score(df, model, classes).select("prediction")
    job.write.format("noop").mode("overwrite").save()
    started = time.perf_counter()
    for _ in range(runs):
        job.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - started) / runs * 1000.0
