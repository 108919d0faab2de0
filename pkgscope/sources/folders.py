"""Paths through Hadoop's file systems, so that whatever Spark reads can be asked for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be a pattern, names anything."""
    fs, p = _fs(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"{old} was not renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which the driver and all executors share; on a local master without that setting, one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options) -> DataFrame:
    """The table at a path, or an empty one of the same schema where nothing is there: an artifact that is missing gives nulls in a left join, not a failed job."""
    if exists(spark, path):
        return spark.read.schema(schema).options(**options).format(kind).load(path)
    return spark.createDataFrame([], schema)
