"""Model registry: pipeline folders plus a table with one row per saved model."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions.scalars import path_key
from fingerloom.schema import TARGET
from fingerloom.sources.commits import file_system as _file_system
from fingerloom.sources.commits import put_if_absent as _put_if_absent

GLOBAL_KEY = "global"
#: A model serves everybody or one user. The scope keeps a user who is called "global" apart from the global model.
GLOBAL, PERSONAL = "global", "personal"

REGISTRY_SCHEMA = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("model_key", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("target_name", T.StringType()),
    T.StructField("label_classes", T.ArrayType(T.StringType())),
    T.StructField("lineage", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("promoted_at", T.TimestampType()),
    # How rows were split for the model; NULL for a model fitted to all rows.
    T.StructField("split_seed", T.LongType()),
    T.StructField("test_share", T.DoubleType()),
    T.StructField("cleaned", T.BooleanType()),
    T.StructField("deduplicated", T.BooleanType()),
])


@dataclass(frozen=True)
class Split:
    """How the rows of a model were prepared and split: what it takes to find its held-out rows again."""

    seed: int
    test_share: float
    cleaned: bool
    deduplicated: bool


def key_of(spark: SparkSession, user: str | None) -> tuple[str, str]:
    """Scope and model key of one user id, by the same rule as for a column; the global ones without a user."""
    if user is None or not user.strip():
        return GLOBAL, GLOBAL_KEY
    return PERSONAL, spark.range(1).select(path_key(F.lit(user))).first()[0]


def _folder(root: str, scope: str, key: str) -> str:
    return f"{root.rstrip('/')}/registry/{scope}/{key}"


def _read_commit(spark: SparkSession, path: str) -> dict | None:
    file, system = _file_system(spark, path)
    if not system.exists(file):
        return None
    rows = spark.read.schema(REGISTRY_SCHEMA).json(path).collect()
    return rows[0].asDict() if rows else None


def _copy(spark: SparkSession, source: str, target: str) -> None:
    """A folder with all its files, from store to store."""
    (file, system), (copy, own) = _file_system(spark, source), _file_system(spark, target)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(system, file, own, copy, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be copied to {target}.")


def save_model(spark: SparkSession, model: PipelineModel, root: str, *, key: str, algorithm: str,
               features: Sequence[str], classes: Sequence[str], scope: str = PERSONAL, lineage: str = "production", promote: bool = True,
               token: str | None = None, split: Split | None = None, saved: str | None = None) -> str:
    """Save the pipeline under ``root`` and commit its registry row; returns the path of the model that counts.

    ``saved`` is a folder that holds this pipeline already: its files are copied, which takes no Spark job.

    ``token`` names the request. A request that is repeated, as a micro-batch may be, finds its commit and leaves one model and one row; of
    two writers with one token the first to commit wins. A model is listed once its commit file is there, and the file is written after
    the model, so a reader never sees half of one.
    """
    name = f"{algorithm}-{hashlib.sha256(token.encode()).hexdigest()[:32] if token is not None else uuid.uuid4().hex}"
    commit = f"{_folder(root, scope, key)}/{lineage}-{name}.json"
    if token is not None and (known := _read_commit(spark, commit)):
        return known["model_path"]
    # Each attempt has its own folder; the commit says which one counts.
    path = f"{root.rstrip('/')}/{lineage}/{scope}/{key}-{name}-{uuid.uuid4().hex[:8]}"
    if saved is None:
        model.write().save(path)
    else:
        _copy(spark, saved, path)
    now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    row = {"scope": scope, "model_key": key, "algorithm": algorithm, "model_path": path, "feature_names": list(features), "target_name": TARGET, "label_classes": list(classes),
           "lineage": lineage, "created_at": now, "promoted_at": now if promote else None}
    if split:
        row |= {"split_seed": split.seed, "test_share": split.test_share, "cleaned": split.cleaned, "deduplicated": split.deduplicated}
    if _put_if_absent(spark, commit, json.dumps(row) + "\n"):
        return path
    lost, system = _file_system(spark, path)
    system.delete(lost, True)  # this attempt's own folder
    return _read_commit(spark, commit)["model_path"]


def read_registry(spark: SparkSession, root: str, scope: str | None = None, key: str | None = None) -> DataFrame:
    """All committed rows, or those of one model key, whose folder alone is read then."""
    folder = _folder(root, scope, key) if scope and key else f"{root.rstrip('/')}/registry"
    file, system = _file_system(spark, folder)
    if not system.exists(file):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def stored_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the pipeline folders present below ``root``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*").load(root).select("path"))
    # Listed paths carry scheme and host; the registry's begin as ``root`` was given.
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    bare = lambda path: re.sub("^file:/+", "/", path)
    listed = F.regexp_replace("path", "^file:/+", "/")
    own = F.concat(F.lit(root.rstrip("/")), F.substr(listed, F.lit(len(bare(full)) + 1)))
    inside = F.regexp_extract(own, r"^(.*)/metadata/[^/]+$", 1)
    return (files.select(inside.alias("model_path"))
            .where((F.col("model_path") != "") & ~F.col("model_path").contains("/stages/")).distinct())


def active_models(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The latest promoted row per scope and key, dropped if its artifact is missing (no older one takes over)."""
    promoted = registry.where(F.col("promoted_at").isNotNull() & (F.coalesce("model_path", F.lit("")) != ""))
    row = F.struct(*[c for c in registry.columns if c not in ("scope", "model_key")])
    latest = promoted.groupBy("scope", "model_key").agg(
        F.max_by(row, F.struct("promoted_at", "model_path")).alias("_row")).select("scope", "model_key", "_row.*")
    return latest.join(artifacts.select("model_path"), "model_path", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a pipeline folder is present, asked of its own file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def load_model(spark: SparkSession, root: str, user: str | None = None) -> tuple[PipelineModel, dict]:
    """The active pipeline of a user, or the global one without a user, with its registry row; FileNotFoundError if there is none.

    Only the folder of the row that counts is looked at, so the size of the store does not matter.
    """
    scope, key = key_of(spark, user)
    rows = read_registry(spark, root, scope, key)
    promoted = rows.where(F.col("promoted_at").isNotNull() & (F.coalesce("model_path", F.lit("")) != ""))
    row = promoted.orderBy(F.desc("promoted_at"), F.desc("model_path")).first()
    if row is None or not _exists(spark, row["model_path"]):
        raise FileNotFoundError(f"No active {scope} model for '{key}'.")
    return PipelineModel.load(row["model_path"]), row.asDict()


def resolve_model(spark: SparkSession, root: str, user: str | None) -> tuple[PipelineModel, dict, bool]:
    """The user's own model, of whatever algorithm, or the global one; and whether it is the fallback."""
    if user is not None and user.strip():
        try:
            return *load_model(spark, root, user), False
        except FileNotFoundError:
            pass
    return *load_model(spark, root), True


def artifact_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files of a saved model."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0]
