"""Table layouts that spare work: buckets by key, and versions whose merges rewrite only what changes."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions import scalars as S
from fingerloom.operators.extract import apply_outlier_flags
from fingerloom.sources.commits import names, put_if_absent

BUCKETS = 64
#: The normalised user id, by which session tables are bucketed.
USER_KEY = "user_key"


def save_bucketed(df: DataFrame, table: str, path: str, key: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Store ``df`` as a table bucketed and sorted by ``key``, a file for each bucket; read it back.

    An equality on the key reads one bucket, and a join of two tables bucketed alike on their keys shuffles neither.
    """
    spark = df.sparkSession
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def save_sessions_by_user(sessions: DataFrame, table: str, path: str, *, user: str = "user_id", buckets: int = BUCKETS) -> DataFrame:
    """Sessions bucketed by :data:`USER_KEY`, which ``filter_user`` looks for."""
    return save_bucketed(sessions.withColumn(USER_KEY, S.user_key(F.col(user))), table, path, USER_KEY, buckets=buckets)


@dataclass(frozen=True)
class Version:
    """One state of a table: which folder holds each part."""

    number: int
    parts: dict[str, str]
    schema: T.StructType
    id_column: str
    n_parts: int


def _part(id_: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("string")), F.lit(n)).cast("int")


def _write(df: DataFrame, root: str, id_column: str, n_parts: int) -> dict[str, str]:
    """Write rows by part into a folder of their own; the folder of each part that has rows."""
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    dealt = df.withColumn("_part", _part(F.col(id_column), n_parts)).repartition("_part")
    dealt.write.partitionBy("_part").parquet(folder)
    return {name.removeprefix("_part="): f"{folder}/{name}" for name in names(df.sparkSession, folder) if name.startswith("_part=")}


def _commit(spark: SparkSession, root: str, version: Version) -> bool:
    text = json.dumps({"parts": version.parts, "schema": version.schema.json(), "id_column": version.id_column, "n_parts": version.n_parts})
    return put_if_absent(spark, f"{root.rstrip('/')}/versions/{version.number:012d}.json", text)


def create_versioned(df: DataFrame, root: str, id_column: str, *, parts: int = BUCKETS) -> Version:
    """Store ``df`` as the first version of a table at ``root``; an error if there is one."""
    version = Version(0, _write(df, root, id_column, parts), df.schema, id_column, parts)
    if not _commit(df.sparkSession, root, version):
        raise ValueError(f"There is a table at {root} already.")
    return version


def current_version(spark: SparkSession, root: str) -> Version:
    """The latest committed version."""
    numbers = [n for n in names(spark, f"{root.rstrip('/')}/versions") if n.endswith(".json")]
    if not numbers:
        raise FileNotFoundError(f"No table at {root}.")
    found = json.loads(spark.read.text(f"{root.rstrip('/')}/versions/{max(numbers)}", wholetext=True).first()[0])
    return Version(int(max(numbers)[:-5]), found["parts"], T.StructType.fromJson(json.loads(found["schema"])), found["id_column"], found["n_parts"])


def read_versioned(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The rows of a version, by default the latest; what a merge does meanwhile is not seen."""
    version = version or current_version(spark, root)
    if not version.parts:
        return spark.createDataFrame([], version.schema)
    return spark.read.schema(version.schema).parquet(*sorted(version.parts.values()))


def merge_outlier_flags(spark: SparkSession, root: str, outlier_ids: DataFrame, *, clear_existing: bool = True, flag: str = "IsOutlier") -> Version:
    """Set the flag of the listed ids, and clear or keep the others'; returns the version that has them.

    Only parts with a row whose flag changes are written anew; the files of the others stay as they are. A call that changes nothing, as a
    repeated one, makes no version. A reader sees the version before or the one after, and of two merges on one version the second
    to commit is an error and can be called again.
    """
    version = current_version(spark, root)
    rows = read_versioned(spark, root, version)
    merged = apply_outlier_flags(rows.withColumn("_was", F.col(flag)), outlier_ids, clear_existing=clear_existing, id_column=version.id_column, flag=flag)
    changed = merged.where(~F.col(flag).eqNullSafe(F.col("_was"))).select(_part(F.col(version.id_column), version.n_parts).alias("p")).distinct()
    touched = sorted(str(r["p"]) for r in changed.collect())  # at most the number of parts
    if not touched:
        return version
    stale = spark.read.schema(version.schema).parquet(*[version.parts[p] for p in touched])
    fresh = apply_outlier_flags(stale, outlier_ids, clear_existing=clear_existing, id_column=version.id_column, flag=flag).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in version.schema])
    following = Version(version.number + 1, {**version.parts, **_write(fresh, root, version.id_column, version.n_parts)}, version.schema, version.id_column, version.n_parts)
    if not _commit(spark, root, following):
        raise RuntimeError("Another merge was committed first; call again.")
    return following
