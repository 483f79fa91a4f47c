"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fingerloom", *, master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster sizing is left to the submitted configuration."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Wide expressions make generated methods the JVM refuses to compile; above this size Spark
        # splits them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder: on a cluster a machine-local
    folder would be lost with its executor, so there the setting is required.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        path = tempfile.mkdtemp(prefix="fingerloom-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: columnar, prunable, splittable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame | None) -> None:
    """Delete tables that :func:`materialized` wrote, once what was made of them is written or at hand."""
    for df in stored:
        if getattr(df, "scratch", None):
            discard_path(df.sparkSession, df.scratch)


def discard_path(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of intermediate data, if there is one."""
    if path:
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def spread(df: DataFrame, key: str, *, rows: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` if the input has fewer tasks than the cluster has cores, or than tasks of ``rows`` rows.

    Meant for narrow rows ahead of per-row work that costs more than the shuffle; input that is
    already split well is left alone.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        tasks = max(tasks, -(-df.count() // rows))
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df
