"""Seeded samples, rank bands, pairings, look-ups by key and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    """A fixed order of keys that depends on the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first of the seeded order."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def rank_bands(rows: DataFrame, order: list[Column], bounds: dict[str, int]) -> DataFrame:
    """The best rows with ``place`` and ``band``, up to the last bound; bounds go up. Only that many rows are ranked."""
    top = rows.orderBy(*order).limit(max(bounds.values()))
    band = None
    for name, bound in bounds.items():
        inside = F.col("place") <= bound
        band = F.when(inside, name) if band is None else band.when(inside, name)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).withColumn("band", band)


def difference(names: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of names that none of the others holds."""
    for o in others:
        names = names.subtract(o)
    return names


def shared_groups(rows: DataFrame, group: Column, split: str) -> DataFrame:
    """one, other, n: groups that two splits share. A group's splits are collected, so lists are as long as there are splits."""
    of = rows.groupBy(group.alias("g")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return of.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.other").agg(F.count("*").alias("n"))


def pair_up(hosts: DataFrame, donors: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """host, donor: each host at most once, with the donor of the same place in one of 256 seeded cells; pairs of one group are rejected.

    Cells keep the numbering out of one task; both sides meet by an equi-join on cell and place.
    """
    def numbered(rows: DataFrame, name: str) -> DataFrame:
        h = seeded(F.col(key), seed)
        rows = rows.select(F.col(key).alias(name), F.col(group).alias(f"{name}_group"), h.alias("_h"), F.left(h, F.lit(2)).alias("_cell"))
        return rows.withColumn("_place", F.row_number().over(W.partitionBy("_cell").orderBy("_h", name))).drop("_h")

    pairs = numbered(hosts, "host").join(numbered(donors, "donor"), ["_cell", "_place"])
    return pairs.where("host_group <> donor_group").drop("_cell", "_place")


def with_synthetic(train: DataFrame, synthetic: DataFrame, group: str) -> DataFrame:
    """train and those synthetic rows whose host and donor groups are both among its groups."""
    groups = train.select(group).distinct()
    kept = synthetic
    for side in ("host_group", "donor_group"):
        kept = kept.join(groups.withColumnRenamed(group, side), side, "left_semi")
    return train.unionByName(kept.drop("host_group", "donor_group"), allowMissingColumns=True)


def last_by_key(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, value: the value of each key's last row."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value))


def within_quota(jobs: DataFrame, held: DataFrame, key: str, group: str, order: list[str], quota: int) -> DataFrame:
    """Jobs whose key is not held yet, the first ``quota`` of each group; each partition is cut to them before the exchange."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return jobs.join(held, key, "left_anti").withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def interleaved(pools: DataFrame, key: str, seed: int, cells: int = 256) -> DataFrame:
    """Rows with ``place``, a seeded order over all pools, numbered from 1 in two levels: cells of the hash, then inside a cell."""
    rows = pools.withColumn("_h", seeded(F.col(key), seed)).withColumn("_cell", F.left("_h", F.lit(2)))
    sums = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_cell", base.alias("_base"))
    inside = F.row_number().over(W.partitionBy("_cell").orderBy("_h", key))
    return rows.join(F.broadcast(sums), "_cell").withColumn("place", F.col("_base") + inside).drop("_h", "_cell", "_base")
