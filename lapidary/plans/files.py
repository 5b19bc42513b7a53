"""Files of the driver on any file system that Spark reaches (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p))


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file, the folders above it included; an older one goes."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
