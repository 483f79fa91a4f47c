"""Evaluation tables from (true, predicted) label pairs, optionally per group. A NULL label is a label of its own.

Everything starts from one count per (group, true, predicted): a single shuffle with map-side
combine, after which the data has at most classes x classes rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S

# Sentences that readers of the reports match on.
NO_MISCLASSIFICATION = "No primary misclassification detected on evaluation data"


def pair_counts(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(true_label, predicted_label, n_rows) over the union of labels, zero-filled."""
    return _filled(pair_counts(df, truth, predicted, by), by)


def _filled(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    both = F.array(F.col("y"), F.col("p"))
    labels = counts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(both)))).alias("_labels"))
    grid = (labels.select(*by, F.explode("_labels").alias("y"), "_labels")
            .select(*by, "y", F.explode("_labels").alias("p")))
    keys = [*by, "y", "p"]
    cells = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return grid.join(cells, same, "left").select(
        *by, F.col("y").alias("true_label"), F.col("p").alias("predicted_label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


def state_confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion matrix over 0/1 if every label of the data is a known state name, else over the labels."""
    counts = pair_counts(df, truth, predicted)
    y, p = S.binary_state(F.col("y")), S.binary_state(F.col("p"))
    binary = counts.agg(F.bool_and(y.isNotNull() & p.isNotNull())).first()[0]
    if not binary:
        return _filled(counts, ())
    mapped = counts.select(y.cast("string").alias("y"), p.cast("string").alias("p"), "n")
    return mapped.agg(*[
        F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("p") == b), F.col("n"))), F.lit(0)).alias(f"c{a}{b}")
        for a in "01" for b in "01"
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("true_label"), F.lit(b).alias("predicted_label"), F.col(f"c{a}{b}").alias("n_rows"))
        for a in "01" for b in "01"])))


def class_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1_score, support per label; 0 where a ratio is undefined."""
    return _class_metrics(pair_counts(df, truth, predicted, by), by)


def _class_metrics(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    n, hit = F.col("n"), F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = counts.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("label"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")))))
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *by, "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1_score"),
        "support", "hits")


def macro_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro precision / recall / F1, weighted F1 and support, one row per group."""
    return class_metrics(df, truth, predicted, by).groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("support"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    classes = class_metrics(df, truth, predicted)
    support = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / support
    names = ("precision", "recall", "f1_score")
    line = lambda label, values: F.struct(
        F.lit(label).alias("label"), *[v.cast("double").alias(n) for v, n in zip(values, names)],
        support.alias("support"))
    none = F.lit(None)
    summary = classes.agg(F.array(
        line("accuracy", (none, none, F.sum("hits") / support)),
        line("macro avg", tuple(F.avg(c) for c in names)),
        line("weighted avg", tuple(weighted(c) for c in names))).alias("_lines"))
    return classes.drop("hits").unionByName(summary.select(F.inline("_lines")))


def primary_misclassification(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The largest off-diagonal cell, first in (true, predicted) order, as a sentence per group."""
    counts = pair_counts(df, truth, predicted, by)
    wrong = F.when(~F.col("y").eqNullSafe(F.col("p")), F.struct((-F.col("n")).alias("k"), F.col("y"), F.col("p")))
    return counts.groupBy(*by).agg(F.min(wrong).alias("_w")).select(
        *by,
        F.coalesce(-F.col("_w.k"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.when(F.col("_w").isNull(), NO_MISCLASSIFICATION).otherwise(
            F.format_string("True class %s was frequently misclassified as %s", F.coalesce("_w.y", F.lit("None")), F.coalesce("_w.p", F.lit("None")))
        ).alias("summary"))


def quality_rank(leaderboard: DataFrame, by: Sequence[str] = (), position: str = "position") -> DataFrame:
    """``quality_rank`` by accuracy, macro F1, weighted F1, support; ties keep input order.

    Adds ``quality_ties``, the rows equal to the best one. A group holds one row per candidate.
    """
    keys = ["accuracy", "macro_f1", "weighted_f1", "support"]
    group = Window.partitionBy(*by)
    best = F.max(F.struct(*keys)).over(group)
    return leaderboard.withColumns({
        "quality_rank": F.row_number().over(group.orderBy(*[F.desc(k) for k in keys], position)),
        "_tied": F.struct(*keys) == best,
    }).withColumn("quality_ties", F.count_if(F.col("_tied")).over(group)).drop("_tied")


def best_by_efficiency(leaderboard: DataFrame, by: Sequence[str] = (), position: str = "position") -> DataFrame:
    """Per group: the fastest, then smallest, of the rows tied for best quality; the best row if none is timed."""
    keys = ["accuracy", "macro_f1", "weighted_f1", "support"]
    group = Window.partitionBy(*by)
    timed = F.col("predict_ms").isNotNull() & F.col("model_bytes").isNotNull()
    order = F.struct((~timed).alias("untimed"), F.when(timed, F.col("predict_ms")), F.when(timed, F.col("model_bytes")),
                     F.col(position))
    tied = leaderboard.withColumn("_best", F.max(F.struct(*keys)).over(group)).where(F.struct(*keys) == F.col("_best"))
    row = F.struct(*[c for c in leaderboard.columns if c not in by])
    return tied.groupBy(*by).agg(F.min_by(row, order).alias("_row")).select(*by, "_row.*")


def choose_winner(leaderboard: DataFrame, by: Sequence[str] = (), f1: str = "macro_f1", name: str = "algorithm") -> DataFrame:
    """Best F1, then accuracy, then name, per group."""
    row = F.struct(*[c for c in leaderboard.columns if c not in by])
    order = F.struct(-F.col(f1), -F.col("accuracy"), F.col(name))
    return leaderboard.groupBy(*by).agg(F.min_by(row, order).alias("_row")).select(*by, "_row.*")


def top_features(scores: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` largest of (feature, importance, position); ties in column order."""
    return scores.orderBy(F.desc("importance"), "position").limit(limit).select("feature", "importance")


def top_predictive_feature(scores: DataFrame) -> DataFrame:
    """The most important feature; the first column wins a tie."""
    order = F.struct(-F.col("importance"), F.col("position"))
    return scores.agg(F.min_by(F.struct("feature", "importance"), order).alias("_top")).select("_top.*")
