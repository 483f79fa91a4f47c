"""Files that decide: created once, whoever comes first, in whatever store the path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The path as the store knows it, and the store."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``; False if it is there already. The store's exclusive create decides between two writers."""
    file, system = file_system(spark, path)
    try:
        out = system.create(file, False)
    except Py4JJavaError:
        if system.exists(file):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder; none if it does not exist."""
    file, system = file_system(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(file)] if system.exists(file) else []
