"""Extraction of training rows from the feature and session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.operators.ordering import with_sequence
from fingerloom.schema import FINGERS, PASCAL_TO_SNAKE, TARGET, finger_columns


def pascal_errors() -> dict:
    return dict(zip(FINGERS, finger_columns("error", case="pascal")))


def not_outlier(features: DataFrame, flag: str = "IsOutlier") -> DataFrame:
    """Rows whose outlier flag is 0 or NULL."""
    return features.where(F.coalesce(F.col(flag), F.lit(0)) == 0)


def join_feature_session(features: DataFrame, typing: DataFrame) -> DataFrame:
    """Inner join on the session id. Both ids are unique, so no key is hot; the join strategy is left to AQE."""
    typing = typing.withColumnsRenamed({"Id": "SessionKey", "CreatedAt": "SessionCreatedAt"})
    return features.join(typing, F.col("TypingSessionId") == F.col("SessionKey"), "inner").drop("SessionKey")


def training_rows(features: DataFrame, typing: DataFrame, *, label_rule: str = "coalesce",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """26 double features plus the label of all rows not flagged as outliers.

    ``label_rule``: ``coalesce`` falls back to the inferred finger only on NULL, ``valid`` also on
    blank and unknown labels.
    """
    resolve = {"coalesce": S.label_coalesce, "valid": S.label_valid_or_inferred}[label_rule]
    joined = join_feature_session(not_outlier(features), typing)
    label = resolve(F.col("WeakestFinger"), S.weakest_by_max_error(pascal_errors()))
    return joined.select(
        *keep,
        F.col("Wpm").cast("double").alias("wpm"),
        S.accuracy_to_unit(F.col("Accuracy")).cast("double").alias("accuracy"),
        *[F.expr(f"double({p}) AS {s}") for p, s in PASCAL_TO_SNAKE.items()],
        label.alias(TARGET),
    )


def timing_averages(features: DataFrame) -> DataFrame:
    """Feature id, mean dwell and flight time over the eight fingers, and the outlier flag."""
    return features.select(
        F.col("Id").cast("string").alias("session_feature_id"),
        S.mean_of(finger_columns("dwell", case="pascal")).alias("dwell_time_avg"),
        S.mean_of(finger_columns("flight", case="pascal")).alias("flight_time_avg"),
        F.coalesce(F.col("IsOutlier"), F.lit(0)).alias("is_outlier"),
    )


def pending_training(features: DataFrame, typing: DataFrame) -> DataFrame:
    """Rows not yet used for training that have a valid or inferred label, with timing averages."""
    joined = join_feature_session(features.where(F.col("IsUsedForTraining") == 0), typing)
    label = S.label_valid_or_inferred(F.col("WeakestFinger"), S.weakest_by_max_error(pascal_errors()))
    return joined.select(
        F.col("TypingSessionId"), F.col("Id").alias("SessionFeatureId"),
        F.col("SessionCreatedAt").alias("SessionCapturedAt"), F.col("CreatedAt").alias("FeatureCapturedAt"),
        label.alias(TARGET),
        S.mean_of(finger_columns("flight", case="pascal")).alias("FlightTime"),
        S.mean_of(finger_columns("dwell", case="pascal")).alias("DwellTime"),
    ).where(F.col(TARGET).isNotNull())


def pending_sequence(features: DataFrame, typing: DataFrame) -> DataFrame:
    """Pending rows numbered 1..n by capture time (ties by feature id)."""
    return with_sequence(pending_training(features, typing), ["FeatureCapturedAt", "SessionFeatureId"], "Sesi")


def pending_preview(features: DataFrame, typing: DataFrame, limit: int = 25) -> DataFrame:
    """The first ``limit`` pending rows; a top-n, so the whole table is never sorted or numbered."""
    from pyspark.sql import Window

    order = ["FeatureCapturedAt", "SessionFeatureId"]
    top = pending_training(features, typing).orderBy(*order).limit(limit)
    return top.withColumn("Sesi", F.row_number().over(Window.orderBy(*order)))


def filter_user(df: DataFrame, user_id: str | None, *, column: str = "user_id") -> DataFrame:
    """Rows of one user, matched on the trimmed lower-case id; errors on a blank or unknown user.

    A table with a ``user_key`` column is matched on that column, so of one bucketed by it a single bucket is read.
    """
    if user_id is None:
        return df
    wanted = user_id.strip().lower()
    if not wanted:
        raise ValueError("user_id must be non-empty.")
    if column not in df.columns:
        raise ValueError(f"Column {column} is required to filter by user.")
    rows = df.where((F.col("user_key") if "user_key" in df.columns else S.user_key(F.col(column))) == wanted)
    if rows.isEmpty():
        raise ValueError(f"No rows found for user_id '{user_id}'.")
    return rows


def merge_history(history: DataFrame | None, inline: DataFrame | None) -> DataFrame:
    """Stored rows followed by inline rows over the union of their columns."""
    if inline is None:
        if history is None:
            raise ValueError("Neither stored nor inline rows were given.")
        return history
    return inline if history is None else history.unionByName(inline, allowMissingColumns=True)


def normalize_inline_rows(rows: DataFrame, requested_user: str | None = None) -> DataFrame:
    """Payload rows with label, accuracy and missing user id put into canonical form."""
    out = rows.withColumns({
        TARGET: S.normalize_label(F.col(TARGET), lower=True),
        "accuracy": S.accuracy_to_unit_bounded(F.col("accuracy").cast("double")),
    })
    if requested_user is None:
        return out
    given = F.col("user_id") if "user_id" in rows.columns else F.lit(None).cast("string")
    return out.withColumn("user_id", F.when(F.coalesce(given, F.lit("")) == "", requested_user).otherwise(given))


def unpivot_fingers(sessions: DataFrame, id_column: str = "session_id") -> DataFrame:
    """Long form: one row per session and finger with error, dwell and flight."""
    parts = ", ".join(f"'{f}', error_{f}, dwell_{f}, flight_{f}" for f in FINGERS)
    return sessions.selectExpr(
        id_column, f"stack({len(FINGERS)}, {parts}) as (finger, error_rate, dwell_ms, flight_ms)")


def apply_outlier_flags(features: DataFrame, outlier_ids: DataFrame, *, clear_existing: bool = True,
                        id_column: str = "Id", flag: str = "IsOutlier") -> DataFrame:
    """Set the flag of the listed ids; other rows are cleared, or keep their flag.

    A left join to the distinct id list; ids are unique on both sides, so no key is hot.
    """
    listed = outlier_ids.select(F.col(outlier_ids.columns[0]).alias("_listed")).distinct()
    other = F.lit(0) if clear_existing else F.col(flag)
    joined = features.join(listed, features[id_column].cast("string") == F.col("_listed").cast("string"), "left")
    return joined.withColumn(flag, F.when(F.col("_listed").isNotNull(), 1).otherwise(other)).drop("_listed")
