"""Leakage-free splits: merged families, held-out periods and grouped deals."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def behaviour_print(features: list[str], digits: int = 4) -> Column:
    """The features rounded half to even, as one value that is equal only where all of them are; a null counts as 0."""
    return F.concat_ws(":", *[(F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits) + F.lit(0.0)).cast("string") for c in features])


def merge_families(rows: DataFrame, name: str, fingerprint: str) -> DataFrame:
    """name, family: names that share fingerprints, directly or through others, get the least name."""
    pairs = _cut(rows.select(F.col(name).alias("name"), F.col(fingerprint).alias("print")).distinct())
    labels = _cut(pairs.select("name", F.col("name").alias("family")).distinct())
    while True:
        prints = pairs.join(labels, "name").groupBy("print").agg(F.min("family").alias("low"))
        low = pairs.join(prints, "print").groupBy("name").agg(F.min("low").alias("low"))
        up = labels.select(F.col("name").alias("low"), F.col("family").alias("higher"))
        step = labels.join(low, "name").join(up, "low").select("name", F.least("low", "higher").alias("family"), (F.least("low", "higher") != F.col("family")).alias("moved"))
        step = _cut(step)
        labels = step.select("name", "family")
        if step.where("moved").isEmpty():
            return labels


def split_future(rows: DataFrame, group: str, date: str, cutoff: str, label: str = "label") -> DataFrame:
    """Malicious rows of the cutoff or later whose group has no other row. A null or empty date is not late."""
    late = F.coalesce((F.col(label) == 1) & (F.col(date) != "") & (F.col(date) >= cutoff), F.lit(False))
    older = rows.where(~late).select(group).distinct()
    return rows.where(late).join(older, group, "left_anti")


def group_shares(rows: DataFrame, group: str, label: str) -> DataFrame:
    """group, n, share: the share of its class's rows that lie before each group, in the order of the group's md5.

    The share is summed in two levels, over the first byte of the md5 and inside it.
    """
    groups = rows.groupBy(group).agg(F.count("*").alias("n"), F.bround(F.avg(label), 0).cast("int").alias("major"))
    groups = groups.withColumn("h", F.md5(F.col(group).cast("string"))).withColumn("cell", F.left("h", F.lit(2)))
    cells = groups.groupBy("major", "cell").agg(F.sum("n").alias("cn"))
    before = W.partitionBy("major").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("major", "cell", F.coalesce(F.sum("cn").over(before), F.lit(0)).alias("base"), F.sum("cn").over(W.partitionBy("major")).alias("total"))
    inside = W.partitionBy("major", "cell").orderBy("h", group).rowsBetween(W.unboundedPreceding, -1)
    share = (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))) / F.col("total")
    return groups.join(F.broadcast(cells), ["major", "cell"]).select(group, "n", share.alias("share"))


def deal_groups(rows: DataFrame, group: str, label: str, test: float = 0.15, validation: float = 0.30) -> DataFrame:
    """group, split: whole groups dealt by the share of their class's rows before them."""
    split = F.when(F.col("share") < test, "test").when(F.col("share") < validation, "validation").otherwise("train")
    return group_shares(rows, group, label).select(group, "n", split.alias("split"))


def rolling_unseen(rows: DataFrame, group: str, period: str) -> DataFrame:
    """period, test_rows, test_groups: rows of groups first seen in that period; prior_rows: rows before it."""
    first = rows.groupBy(group).agg(F.min(period).alias("first"))
    test = rows.join(first, group).where(F.col(period) == F.col("first")).groupBy(period).agg(F.count("*").alias("test_rows"), F.count_distinct(group).alias("test_groups"))
    per = rows.groupBy(period).agg(F.count("*").alias("n"))
    prior = per.select(period, F.coalesce(F.sum("n").over(W.orderBy(period).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("prior_rows"))
    return prior.join(test, period, "left").na.fill(0, ["test_rows", "test_groups"])


def first_releases(rows: DataFrame, covered: DataFrame, name: Column, order: Column) -> DataFrame:
    """One row a normalised name, the least in order, of names that another source does not cover; name is added as ``name``."""
    known = covered.select("name").where("name is not null").distinct()
    first = F.row_number().over(W.partitionBy("name").orderBy(order))
    return rows.withColumn("name", name).join(known, "name", "left_anti").withColumn("_place", first).where("_place = 1").drop("_place")


def running_totals(rows: DataFrame, group: str, order: str, sizes: list[str], cells: int = 1024) -> DataFrame:
    """rows with used_<size> for each of sizes: the sum over the group's rows before each, by an integer order.

    Sums run over ranges of the order first and inside a range second, so that no task holds a whole group.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // cells + 1)
    dealt = rows.withColumn("_cell", F.floor((F.col(order) - F.lit(low or 0)) / width))
    before = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(group, "_cell").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sizes])
    sums = sums.select(group, "_cell", *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_base_{s}") for s in sizes])
    inside = W.partitionBy(group, "_cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    used = {f"used_{s}": F.col(f"_base_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sizes}
    return dealt.join(sums, [group, "_cell"]).withColumns(used).drop("_cell", *[f"_base_{s}" for s in sizes])


def running_total(rows: DataFrame, group: str, order: str, size: str, cells: int = 1024) -> DataFrame:
    """rows with ``used``: the size of the group's rows before each, by an integer order."""
    return running_totals(rows, group, order, [size], cells).withColumnRenamed(f"used_{size}", "used")


def folds(rows: DataFrame, group: str, label: str, n: int = 5) -> DataFrame:
    """group, fold: whole groups dealt into n folds by the share of their class's rows before them."""
    shares = group_shares(rows, group, label)
    return shares.select(group, "n", F.least(F.floor(F.col("share") * n), F.lit(n - 1)).cast("int").alias("fold"))


def rolling_sides(rows: DataFrame, group: str, period: str, label: str = "label") -> DataFrame:
    """period, side, label, rows and groups of each period's training and test side.

    Test: malware of the period whose group was not seen before. Training: malware before the period without
    the test groups (a group first seen in the period has no earlier row), so both are sums over first
    periods and over periods. Benign rows belong to every period and are not counted here.
    """
    mal = rows.where(F.col(label) == 1)
    first = mal.groupBy(group).agg(F.min(period).alias("_first"))
    test = mal.join(first, group).where(F.col(period) == F.col("_first")).groupBy(period).agg(F.count("*").alias("test_rows"), F.count_distinct(group).alias("test_groups"))
    per = mal.groupBy(period).agg(F.count("*").alias("n"))
    new = first.groupBy(F.col("_first").alias(period)).agg(F.count("*").alias("g"))
    before = W.orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    prior = per.join(new, period, "left").select(
        period, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("train_rows"), F.coalesce(F.sum("g").over(before), F.lit(0)).alias("train_groups"),
    )
    return prior.join(test, period)
