"""Data-quality rules as violation tables, and the checks training jobs stop on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.schema import CV_FOLDS, ERROR_COLUMNS, FEATURES, FINGERS, MIN_PERSONAL_ROWS, RANGE_RULES, TARGET

Rules = Mapping[str, tuple[float, float | None]]


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns absent from the schema; no job runs."""
    return [c for c in required if c not in df.columns]


def feature_violations(df: DataFrame, rules: Rules = RANGE_RULES) -> DataFrame:
    """Rows breaking each rule of each column, in one aggregate pass: (column_name, rule, n_rows)."""
    tests: list[tuple[str, str, str]] = []
    present = [c for c in rules if c in df.columns]
    for c in present:
        low, high = rules[c]
        tests.append((c, "null_or_non_numeric", f"`{c}` IS NULL"))
        tests.append((c, "non_finite", f"abs(`{c}`) = double('inf')"))
        tests.append((c, "below_min", f"`{c}` < {S.number(low)}"))
        if high is not None:
            tests.append((c, "above_max", f"`{c}` > {S.number(high)}"))
    numbers = df.selectExpr(*[f"{S.number_sql(c)} AS `{c}`" for c in present])
    row = numbers.agg(*[F.expr(f"count_if({test}) AS t{i}") for i, (_, _, test) in enumerate(tests)])
    entries = ", ".join(
        f"struct('{c}' AS column_name, '{rule}' AS rule, t{i} AS n_rows)" for i, (c, rule, _) in enumerate(tests))
    return row.selectExpr(f"inline(array({entries}))")


def invalid_error_rows(df: DataFrame) -> DataFrame:
    """Number of rows with any error rate outside 0..1."""
    bad = " OR ".join(f"coalesce(`{c}` < 0 OR `{c}` > 1, false)" for c in ERROR_COLUMNS)
    return df.agg(F.expr(f"count_if({bad}) AS invalid_rows"))


def label_counts(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def label_violations(df: DataFrame, label: str = TARGET, allowed: Sequence[str] = FINGERS, *,
                     min_classes: int = 2, min_class_rows: int = 2) -> DataFrame:
    """(rule, n_found) for null, blank and unsupported labels, number of classes, and sparse classes."""
    counts = label_counts(df.select(S.normalize_label(F.col(label)).alias(label)), label)
    name, n = F.col(label), F.col("n_rows")
    filled = name.isNotNull()
    row = counts.agg(
        F.coalesce(F.sum(F.when(~filled, n)), F.lit(0)).alias("null_labels"),
        F.coalesce(F.sum(F.when(name == "", n)), F.lit(0)).alias("blank_labels"),
        F.coalesce(F.sum(F.when(filled & (name != "") & ~name.isin(*allowed), n)), F.lit(0)).alias("unsupported_labels"),
        F.greatest(F.lit(min_classes) - F.count_if(filled), F.lit(0)).alias("missing_classes"),
        F.count_if(filled & (n < min_class_rows)).alias("sparse_classes"),
    )
    entries = [F.struct(F.lit(c).alias("rule"), F.col(c).cast("bigint").alias("n_found")) for c in row.columns]
    return row.select(F.inline(F.array(*entries)))


def user_readiness(df: DataFrame, *, user: str = "user_id", label: str = TARGET, min_rows: int = MIN_PERSONAL_ROWS,
                   min_class_rows: int = CV_FOLDS) -> DataFrame:
    """Per user: rows, classes, smallest class, and whether both thresholds hold.

    Two aggregations with map-side combine, so a user with most of the rows costs no more than others.
    """
    classes = df.groupBy(user, label).agg(F.count(F.lit(1)).alias("_n"))
    return classes.groupBy(user).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("_n").alias("smallest_class"),
    ).select(
        "*",
        F.when(F.col("n_rows") < min_rows, "insufficient_data")
        .when(F.col("smallest_class") < min_class_rows, "thin_class").otherwise("ready").alias("status"))


def with_inferred_label(df: DataFrame) -> DataFrame:
    errors = dict(zip(FINGERS, ERROR_COLUMNS))
    return df.withColumn("weakest_inferred", S.weakest_by_column_order(errors))


def label_mismatch(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows, mismatches and mismatch rate of the stated against the inferred label."""
    differs = ~F.col("weakest_inferred").eqNullSafe(F.col(label))
    return with_inferred_label(df).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_mismatch"),
        F.round(F.avg(differs.cast("double")), 4).alias("mismatch_rate"))


def label_mismatch_samples(df: DataFrame, order: str, label: str = TARGET, limit: int = 10) -> DataFrame:
    differs = ~F.col("weakest_inferred").eqNullSafe(F.col(label))
    return (with_inferred_label(df).where(differs).orderBy(order).limit(limit)
            .select(order, label, "weakest_inferred", *ERROR_COLUMNS))


def check_features(df: DataFrame, columns: Sequence[str] = FEATURES, *, context: str = "Dataset",
                   rules: Rules = RANGE_RULES) -> DataFrame:
    """The feature columns as doubles; raises ValueError on the first broken rule family."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"{context}: no columns {missing}.")
    all_rules = {c: rules.get(c, (-float("inf"), None)) for c in columns}
    found: dict[str, list[str]] = {}
    for r in feature_violations(df, all_rules).where("n_rows > 0").collect():
        found.setdefault(r["rule"], []).append(r["column_name"])
    if df.isEmpty():
        raise ValueError(f"{context}: no rows.")
    for rule in ("null_or_non_numeric", "non_finite", "below_min", "above_max"):
        if rule in found:
            raise ValueError(f"{context}: rule {rule} is broken by {found[rule]}.")
    return df.withColumns({c: F.expr(S.number_sql(c)) for c in columns})


def check_labels(df: DataFrame, label: str = TARGET, allowed: Sequence[str] = FINGERS, *, context: str = "Dataset",
                 min_classes: int = 2, min_class_rows: int = 2) -> DataFrame:
    """Trimmed labels; raises ValueError on null, blank, unsupported or too few labels."""
    found = {r["rule"]: r["n_found"] for r in label_violations(
        df, label, allowed, min_classes=min_classes, min_class_rows=min_class_rows).collect()}
    for rule in ("null_labels", "blank_labels", "unsupported_labels", "missing_classes", "sparse_classes"):
        if found[rule]:
            raise ValueError(f"{context}: rule {rule} is broken by {found[rule]} in {label} "
                             f"(classes wanted: {min_classes}, rows of each: {min_class_rows}).")
    return df.withColumn(label, S.normalize_label(F.col(label)))
