"""Summary message of the two-sided timing analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.operators.cleaning import flag_two_sided

AVERAGES = ("dwell_time_avg", "flight_time_avg")
# Fixed value: outlier samples shown in a summary.
SAMPLES = 10


def outlier_samples(flagged: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """The first outliers by id: a top-n, not a sort."""
    return (flagged.where(F.col("status") == "outlier").orderBy("session_feature_id").limit(limit)
            .select("session_feature_id", *AVERAGES))


def preprocessing_summary(averages: DataFrame) -> DataFrame:
    """One row: scanned / clean / outlier / rejected counts, IQR bounds per average, first samples."""
    flagged, bounds = flag_two_sided(averages, AVERAGES)
    if set(bounds) != set(AVERAGES):
        raise ValueError("No IQR bounds: the timing averages have no values.")
    hit = lambda s: F.count_if(F.col("status") == s)
    samples = [tuple(r) for r in outlier_samples(flagged).collect()]
    sample_type = "array<struct<session_feature_id:string,dwell_time_avg:double,flight_time_avg:double>>"
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("session_feature_id", *AVERAGES))]) for s in samples])
    return flagged.agg(
        F.count(F.lit(1)).alias("rows_scanned"), hit("clean").alias("rows_clean"),
        hit("outlier").alias("outliers"), hit("rejected").alias("rejected"),
    ).select(
        "*",
        *[F.struct(*[F.lit(getattr(bounds[c], b)).alias(b) for b in ("q1", "q3", "iqr", "lower", "upper")]).alias(c)
          for c in AVERAGES],
        literal.cast(sample_type).alias("samples"))
