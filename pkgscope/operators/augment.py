"""Pairs of host and donor packages for synthetic rows: seeded draws with replacement, met by number in equi-joins.

Each draw picks a host and a kind, and a donor of each class; a benign donor comes from those that look risky in a given share of the
draws, from all otherwise. Pairs of one group are rejected. Packages are numbered in the order of a seeded hash, in two levels, so no task
holds a whole pool, and drawing never meets every host with every donor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files of a host, lines of a benign donor, the share of risky controls, kinds of injection and the counters that look risky.
HOST_FILES, DONOR_LOC, RISKY_SHARE = (5, 300), 2000, 0.75
RISKY = ("call_network", "call_process", "decode_calls", "call_exec", "call_computed_import")


def is_host() -> Column:
    return (F.col("label") == 0) & F.col("pkg_n_files").between(*HOST_FILES)


def is_risky() -> Column:
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in RISKY]) > 0


def is_donor(label: int) -> Column:
    own = (F.col("label") == label) & (F.col("pkg_n_py_files") >= 1)
    return own & (F.col("pkg_loc") <= DONOR_LOC) if label == 0 else own


def number(seed: Column | str) -> Column:
    """A number of 32 bits from a text, the same in every engine."""
    return F.conv(F.left(F.md5(seed), F.lit(8)), 16, 10).cast("long")


def numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with ``no`` from 0, in the order of a seeded hash of key, which must be unique: places inside 256 cells after the sizes of the cells before."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = rows.withColumn("_h", h).withColumn("_cell", F.left("_h", F.lit(2)))
    base = F.coalesce(F.sum("n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("_cell").agg(F.count("*").alias("n")).select("_cell", base.alias("_base"))
    place = F.row_number().over(W.partitionBy("_cell").orderBy("_h", key)) - 1
    return rows.withColumn("_place", place).join(F.broadcast(cells), "_cell").withColumn("no", F.col("_base") + F.col("_place")).drop("_h", "_cell", "_base", "_place")


def draw_pairs(packages: DataFrame, key: str, group: str, n: int, kinds: list[str], seed: int = 1337) -> DataFrame:
    """draw, label, kind, host, host_group, donor, donor_group of at most two pairs a draw.

    packages: key, group, label, pkg_n_files, pkg_n_py_files, pkg_loc and the counters RISKY. A pool without packages gives no pair.
    """
    spark = packages.sparkSession
    pools = {"host": is_host(), "bad": is_donor(1), "good": is_donor(0), "risky": is_donor(0) & is_risky()}
    tables = {p: numbered(packages.where(c).select(F.col(key).alias("id"), F.col(group).alias("grp")), "id", seed) for p, c in pools.items()}
    sizes = {p: t.count() for p, t in tables.items()}
    at = lambda what: number(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("draw").cast("string")))
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), (at("kind") % len(kinds) + 1).cast("int")))
    draws = draws.withColumn("_risky", at("risky") < int(RISKY_SHARE * (1 << 32))).withColumn("_no", at("host") % max(1, sizes["host"]))
    hosted = draws.join(tables["host"].select(F.col("no").alias("_no"), F.col("id").alias("host"), F.col("grp").alias("host_group")), "_no").drop("_no")

    def donated(rows: DataFrame, pool: str, label: int) -> DataFrame:
        own = tables[pool].select(F.col("no").alias("_no"), F.col("id").alias("donor"), F.col("grp").alias("donor_group"))
        return rows.withColumn("_no", at(f"donor{label}") % max(1, sizes[pool])).join(own, "_no").withColumn("label", F.lit(label))

    pairs = donated(hosted, "bad", 1).unionByName(donated(hosted.where("_risky"), "risky", 0)).unionByName(donated(hosted.where("not _risky"), "good", 0))
    return pairs.where("host_group <> donor_group").select("draw", "label", "kind", "host", "host_group", "donor", "donor_group")
