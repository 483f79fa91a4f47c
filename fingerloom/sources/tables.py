"""Readers and writers of session datasets, database tables and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.schema import SESSION_SCHEMA, TARGET


def _checked(df: DataFrame, target: str | None) -> DataFrame:
    if target and target not in df.columns:
        raise ValueError(f"No column {target} in the dataset.")
    if df.isEmpty():
        raise ValueError("The dataset has no rows.")
    return df


def read_sessions(spark: SparkSession, path: str, *, schema: T.StructType = SESSION_SCHEMA, format: str = "csv",
                  target: str | None = TARGET) -> DataFrame:
    """A session dataset with an explicit schema; errors if it is empty or lacks the target.

    The header of a CSV file is matched to the schema by name and order, and a mismatch is an error.
    """
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return _checked(reader.format(format).load(path), target)


def write_sessions(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "overwrite",
                   drop: tuple[str, ...] = ("weakest_inferred",), partition_by: tuple[str, ...] = (),
                   max_rows_per_file: int = 5_000_000) -> None:
    """Write a dataset without helper columns; folders are created by the writer."""
    writer = df.drop(*drop).write.mode(mode).format(format).option("maxRecordsPerFile", max_rows_per_file)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark: SparkSession, source: str, *, format: str = "parquet", columns: list[str] | None = None,
               **options: str) -> DataFrame:
    """A stored table: a path of a file format, or a table over JDBC.

    For JDBC pass ``url``, ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``,
    so the read is split into ranges; column and filter pushdown are left to the source.
    """
    reader = spark.read.format(format).options(**options)
    df = reader.option("dbtable", source).load() if format == "jdbc" else reader.load(source)
    return df.select(*columns) if columns else df


RUN_REPORT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("is_dry_run", T.BooleanType()),
    T.StructField("random_state", T.IntegerType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("champion_model", T.StringType()),
    T.StructField("top_predictive_feature", T.StringType()),
    T.StructField("primary_misclassification", T.StringType()),
    T.StructField("total_rows_processed", T.LongType()),
    T.StructField("evaluation_results", T.ArrayType(T.StructType([
        T.StructField("algorithm", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in (
            "accuracy", "macro_precision", "macro_recall", "macro_f1", "execution_time_ms")],
    ]))),
    T.StructField("model_path", T.StringType()),
    T.StructField("report_created_at", T.TimestampType()),
])


def write_run_reports(reports: DataFrame, path: str) -> None:
    """Append run reports to the report table, one folder per status."""
    known = [f.name for f in RUN_REPORT_SCHEMA]
    columns: list[Column] = [
        (F.col(f.name) if f.name in reports.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RUN_REPORT_SCHEMA]
    if not set(reports.columns) <= set(known):
        raise ValueError(f"Unknown report fields: {sorted(set(reports.columns) - set(known))}")
    reports.select(*columns).write.mode("append").partitionBy("status").json(path)


def read_run_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_REPORT_SCHEMA).json(path)
