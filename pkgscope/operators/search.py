"""Searches and ablations by average precision on grouped folds, with configurations and folds as dimensions of one job.

A configuration says which columns it uses, which rows it may train on, and its parameters. All configurations share the same folds, dealt
by group beforehand, so no group is on both sides. A ridge fit of any configuration is a submatrix of the same sums of products, taken
once by fold and by the set of row conditions that a row meets; boosted trees grow under a key for each configuration and fold.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .boosting import small_table


def draw(space: dict[str, list], trials: int, seed: int = 1337) -> dict[str, dict]:
    """Configurations of a random search, named t1, t2, ...: for each parameter one of its values by a hash of seed, trial and name."""
    def pick(trial: int, name: str):
        return space[name][int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) % len(space[name])]

    return {f"t{i}": {name: pick(i, name) for name in space} for i in range(1, trials + 1)}


def _met(conditions: list[Column]) -> Column:
    """The set of conditions that a row meets, as a mask; a null condition is not met."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def ridge_search(rows: DataFrame, configs: dict[str, dict], fold: str, folds: int = 5, label: str = "label", measured: Column | None = None) -> DataFrame:
    """config, n_columns, ap: the average precision, over the measured rows, of each configuration's out-of-fold scores.

    configs: name -> columns, l2 (1.0) and rows (a condition on training rows; all). Malware weighs benign / malware rows of the fit. Rows with a null label, fold
    or feature take no part; a configuration that has one class in some fold's training rows has ap null. One pass for the sums, one for the scores.
    """
    features = sorted({c for of in configs.values() for c in of["columns"]})
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [label, fold, *features]))
    limited = {name: of["rows"] for name, of in configs.items() if of.get("rows") is not None}
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    d = len(x)
    sums = known.groupBy(F.col(fold).alias("_f"), F.col(label).alias("_y"), _met(list(limited.values())).alias("_m")).agg(
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    ).collect()
    gram: dict = {}
    for r in sums:
        m = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        gram[r["_f"], r["_y"], r["_m"]] = m
    fits, dead = [], set()
    for name, of in configs.items():
        use = [0, *(1 + features.index(c) for c in of["columns"])]
        bit = list(limited).index(name) if name in limited else None
        for k in range(folds):
            b, m = (sum((g for (f, y, mask), g in gram.items() if f != k and y == side and (bit is None or mask >> bit & 1)), np.zeros((d, d))) for side in (0, 1))
            if b[0, 0] == 0 or m[0, 0] == 0:
                dead.add(name)
                continue
            w = b[0, 0] / m[0, 0]
            beta = np.zeros(d)
            system = (b + w * m)[np.ix_(use, use)] + np.diag([0.0] + [of.get("l2", 1.0)] * (len(use) - 1))
            beta[use] = np.linalg.solve(system, w * m[0, use])
            fits.append((name, k, beta.tolist()))
    spark = rows.sparkSession
    table = small_table(spark, [f for f in fits if f[0] not in dead], "key string, _k int, _b array<double>")
    asked = known if measured is None else known.where(measured)
    z = F.aggregate(F.zip_with(F.array(*x), "_b", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    scored = asked.join(F.broadcast(table), F.col(fold) == F.col("_k")).select("key", F.round(z, 9).alias("score"), F.col(label).alias("label"))
    names = small_table(spark, [(n, len(of["columns"])) for n, of in configs.items()], "key string, n_columns int")
    return names.join(boosting.precisions(scored), "key", "left").select(F.col("key").alias("config"), "n_columns", "ap")


def boosted_search(rows: DataFrame, edges: dict[str, list[float]], configs: dict[str, dict], fold: str, folds: int = 5, label: str = "label", measured: Column | None = None, **how) -> tuple[DataFrame, dict]:
    """config, ap and rounds (the mean of its folds' best, 50 at least) of boosted trees, all grown in the same jobs; and the model.

    configs: name -> any of columns, rate, l2, least and rows. A fold's own rows stop its trees.
    """
    names = list(configs)
    allowed = F.array(*[F.when(F.coalesce(of["rows"], F.lit(False)), F.lit(n)) if of.get("rows") is not None else F.lit(n) for n, of in configs.items()])
    dealt = rows.withColumn("_fit", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_own", F.col("_fit") == F.col(fold))
    # Rows of the fold itself are scored under every configuration, others train only where they may.
    dealt = dealt.withColumn("_setting", F.explode(F.when(F.col("_own"), F.array(*map(F.lit, names))).otherwise(F.filter(allowed, lambda c: c.isNotNull()))))
    dealt = dealt.withColumn("_grown", F.concat_ws("|", "_setting", F.col("_fit").cast("string")))
    params = {f"{n}|{k}": {p: v for p, v in of.items() if p != "rows"} for n, of in configs.items() for k in range(folds)}
    model = boosting.train(dealt, edges, label, by="_grown", valid="_own", params=params, **how)
    asked = rows if measured is None else rows.where(measured)
    each = asked.where(F.col(label).isNotNull()).withColumn("_setting", F.explode(F.array(*map(F.lit, names)))).withColumn("_grown", F.concat_ws("|", "_setting", F.col(fold).cast("string")))
    scored = boosting.score(each, model, by="_grown").select(F.col("_setting").alias("key"), F.col("margin").alias("score"), F.col(label).alias("label"))
    rounds = [(n, boosting.mean_rounds({k: b for k, b in model["best"].items() if k.startswith(f"{n}|")})) for n in names]
    found = boosting.precisions(scored).join(F.broadcast(small_table(rows.sparkSession, rounds, "key string, rounds int")), "key")
    return found.select(F.col("key").alias("config"), "ap", "rounds"), model
