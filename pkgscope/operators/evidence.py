"""Files in reading order, contributions to a score, and values against a labelled distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import splits

LEAST_SHARE, MOST_RATIO = 1e-3, 999.0
LEAST_CONTRIBUTION = 1e-3


def first_files(rows: DataFrame, package: str, order: list[Column], most: int) -> DataFrame:
    """rows with ``place``: the first ``most`` of each package; Spark cuts each partition to that many before it exchanges rows."""
    place = F.row_number().over(W.partitionBy(package).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def identifier_shape(rows: DataFrame, key: str, identifier: Column) -> DataFrame:
    """key, len_mean, single_share, distinct_share. Equal identifiers are counted first, so no task holds a whole key."""
    each = rows.groupBy(key, identifier.alias("t")).agg(F.count("*").alias("n"))
    size = F.length("t")
    return each.groupBy(key).agg(
        (F.sum(size * F.col("n")) / F.sum("n")).alias("len_mean"), (F.sum(F.when(size == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("single_share"),
        (F.count("*") / F.sum("n")).alias("distinct_share"),
    )


def top_contributions(rows: DataFrame, key: str, weights: dict[str, float], most: int = 8) -> DataFrame:
    """key, place, feature, value, contribution: the greatest by size, ties by name, without those under LEAST_CONTRIBUTION.

    Features lie in one row each, so ranking needs no shuffle; only their means are broadcast, one row.
    """
    means = rows.agg(*[F.avg(n).alias(f"mean_{n}") for n in weights])
    parts = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), F.round(w * (F.col(n) - F.col(f"mean_{n}")), 6).alias("contribution"))
        for n, w in weights.items()
    ])
    kept = F.filter(parts, lambda p: F.abs(p["contribution"]) >= LEAST_CONTRIBUTION)
    order = F.array_sort(F.transform(kept, lambda p: F.struct((-F.abs(p["contribution"])).alias("size"), p["feature"].alias("feature"), p["value"].alias("value"), p["contribution"].alias("contribution"))))
    ranked = rows.join(F.broadcast(means)).select(key, F.posexplode(F.slice(order, 1, most)).alias("at", "p"))
    return ranked.select(key, (F.col("at") + 1).alias("place"), "p.feature", "p.value", "p.contribution")


def distribution(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, value, tail, malicious_share, benign_share, ratio for each value of integer features; a null label is a value to look up only.

    Values are counted first; running sums go over ranges of values, then inside a range.
    """
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in features])).alias("f")).select("label", "f.*")
    steps = long.groupBy("feature", "value").agg(F.count_if(F.col("label") == 1).alias("mal"), F.count_if(F.col("label") == 0).alias("ben"))
    steps = splits.running_totals(steps, "feature", "value", ["mal", "ben"])
    sums = steps.groupBy("feature").agg(F.sum("mal").alias("mals"), F.sum("ben").alias("bens"))
    at = steps.join(F.broadcast(sums), "feature")
    # The sums that are there say where the middle is: the first values that reach the two middle places.
    past, total = F.col("used_mal") + F.col("used_ben") + F.col("mal") + F.col("ben"), F.col("mals") + F.col("bens")
    reach = lambda place: F.min(F.when(past > place, F.col("value")))
    middle = ((reach(F.floor((total - 1) / 2)) + reach(F.floor(total / 2))) / 2).alias("mid")
    at = at.join(F.broadcast(at.groupBy("feature").agg(middle)), "feature")
    low = F.col("value") <= F.col("mid")

    def share(n: str) -> Column:
        return F.when(low, F.col(f"used_{n}") + F.col(n)).otherwise(F.col(f"{n}s") - F.col(f"used_{n}")) / F.col(f"{n}s")

    m, b = share("mal"), share("ben")
    return at.select(
        "feature", "value", F.when(low, "le").otherwise("ge").alias("tail"), F.round(m, 4).alias("malicious_share"), F.round(b, 4).alias("benign_share"),
        F.round(F.least(m / F.greatest(b, F.lit(LEAST_SHARE)), F.lit(MOST_RATIO)), 2).alias("ratio"),
    )
