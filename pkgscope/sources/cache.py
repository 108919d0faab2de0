"""An incremental store of vectors by key: only keys not held yet are embedded, appended once, and checked while they are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folders

STORED = "key string, embedding array<float>, batch int"


class EmptyVectors(RuntimeError):
    """Too many of the stored vectors are zero: most likely the packages' files were not found."""


def stored(spark, path: str) -> DataFrame:
    return folders.optional(spark, path, STORED)


def extend(rows: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], width: int, most_empty: float = 0.1) -> dict:
    """Adds the vectors of rows (key and whatever embed needs) whose keys are not held; returns written, total and empty.

    embed: rows to (key, embedding); a key for which it gives nothing gets a zero vector, so that it is not tried again. Each run is one batch,
    a partition that is replaced whole if the run is repeated after a failure. Counts are observed in the writing pass. Null keys go; of repeated
    keys one row stays. Raises EmptyVectors, after the batch is stored, if more than a tenth of all vectors are zero.
    """
    spark = rows.sparkSession
    held = stored(spark, path)
    before = held.agg(F.count("*").alias("n"), F.count_if(~F.exists("embedding", lambda x: x != 0)).alias("empty"), F.coalesce(F.max("batch"), F.lit(-1)).alias("batch")).first()
    todo = rows.where("key is not null").join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    made = todo.select("key").join(embed(todo).select("key", F.col("embedding").cast("array<float>").alias("embedding")), "key", "left")
    made = made.select("key", F.coalesce("embedding", zero).alias("embedding"), F.lit(before["batch"] + 1).alias("batch"))
    seen = Observation("vectors")
    counted = made.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if(~F.exists("embedding", lambda x: x != 0)), F.lit(0)).alias("empty"))
    counted.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    new = seen.get
    out = {"written": new["n"], "total": before["n"] + new["n"], "empty": before["empty"] + new["empty"]}
    if out["empty"] > out["total"] * most_empty:
        raise EmptyVectors(f"{out['empty']} of {out['total']} vectors are zero")
    return out


HELD = "package string, version string, `set` string, label int, batch int"


def store_jobs(jobs: DataFrame, path: str, quota: dict[str, int]) -> dict[str, int]:
    """Appends jobs (package, version, set, label) whose package and version are not held to the index at path; returns the number stored of each set.

    Of a set with a quota only the first jobs by package and version are stored in one run. Of repeated jobs one stays; a null version is one of its own. A run is one
    batch, replaced whole if it is repeated after a failure.
    """
    spark = jobs.sparkSession
    held = folders.optional(spark, path, HELD)
    batch = held.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first()["b"] + 1
    known = held.select(F.struct("package", F.coalesce("version", F.lit("\x00")).alias("version")).alias("_held")).distinct()
    keyed = jobs.withColumn("_held", F.struct("package", F.coalesce("version", F.lit("\x00")).alias("version"))).dropDuplicates(["_held"])
    fresh = keyed.join(known, "_held", "left_anti")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("set")) if quota else F.lit(None).cast("int")
    place = F.row_number().over(W.partitionBy("set").orderBy("package", "version"))
    # Sets without a quota need no order, and so no exchange.
    capped = fresh.where(F.col("set").isin(list(quota))).withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    free = fresh.where(~F.coalesce(F.col("set").isin(list(quota)), F.lit(False)))
    new = capped.unionByName(free).select("package", "version", "set", F.col("label").cast("int").alias("label"), F.lit(batch).alias("batch"))
    new.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    stored = folders.optional(spark, path, HELD).where(F.col("batch") == batch)
    return {r["set"]: r["count"] for r in stored.groupBy("set").count().collect()}
