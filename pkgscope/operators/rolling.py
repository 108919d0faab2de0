"""Monthly retraining with its rows: each period's model from what was known before it, in one pass over all periods.

The model is a weighted ridge regression of the label, clamped to 0..1, whose fit needs only sums of products. Those are added
up by class, period and fold once; sums over all earlier periods (a window over as many rows as there are periods and folds)
give every period's fit, and taking a fold's sums away gives the fit that scores that fold. The driver solves systems of d + 1 unknowns
for periods x folds. Malware of a period is tested if its group was not seen before, so no earlier row shares its group and
nothing needs to be taken from the training sums; benign rows are tested in every period or never, as ``held`` says.
Malware weighs benign / malware rows of the fit. Rows with a null label, group or feature take no part; malware without a
date (null or empty) counts as older than all periods. A period without new malware, or without malware before it, has no rows.

Thresholds rest on the scores of every training row under every later model, periods x rows numbers, which are made in numpy, a batch of
rows at a time, and leave a task only as counts: first of ranges of scores, then of the scores in the ranges that hold a threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics
from .boosting import small_table

PRIOR = -1


def _sums(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    return rows.groupBy(*keys).agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))])


def period_fits(benign: DataFrame, malware: DataFrame, features: list[str], period: str, fold: str, folds: int, l2: float) -> list[tuple]:
    """(period, fold, coefficients with the intercept first): the fit from malware before each period without a fold, and with all (fold PRIOR)."""
    d = len(features) + 1
    names = [f"s{i}_{j}" for i in range(d) for j in range(i, d)]
    periods = malware.select(period).distinct()
    grid = periods.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    before = W.partitionBy(fold).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    by_period = grid.join(_sums(malware, features, [period, fold]), [period, fold], "left")
    by_period = by_period.select(period, fold, *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in names]).collect()

    def matrix(r) -> np.ndarray:
        m = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        return m

    ben = {r[fold]: matrix(r) for r in _sums(benign, features, [fold]).collect()}
    mal: dict = {}
    for r in by_period:
        mal.setdefault(r[period], {})[r[fold]] = matrix(r)
    out = []
    for p, own in sorted(mal.items()):
        for k in [PRIOR, *range(folds)]:
            zero = np.zeros((d, d))
            b, m = (sum((part[f] for f in part if f != k), zero) for part in (ben, own))
            if b[0, 0] > 0 and m[0, 0] > 0:
                weight = b[0, 0] / m[0, 0]
                system = b + weight * m + np.diag([0.0] + [l2] * (d - 1))
                out.append((p, k, np.linalg.solve(system, weight * m[0]).tolist()))
    return out


def rolling_scores(
    rows: DataFrame, features: list[str], group: str, period: str, held: Column, fold: Column, label: str = "label", folds: int = 5, l2: float = 1.0,
) -> DataFrame:
    """The tested rows of every period: their columns with ``period`` in place, prob, and the period's thresholds t_f05, t_fpr1, t_fpr05 and t_strict.

    Thresholds come from the training rows, each scored by the fit without its fold. held: benign rows to test, and never to train on.
    """
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in [label, group, *features])).withColumns({"_held": F.coalesce(held, F.lit(False)), "_fold": fold.cast("int")})
    rows = rows.withColumn(period, F.coalesce(F.col(period).cast("string"), F.lit("")))
    malware = rows.where(F.col(label) == 1)
    benign = rows.where(F.col(label) == 0)
    first = malware.groupBy(group).agg(F.min(period).alias("_first"))
    unseen = malware.join(first, group).where(F.col(period) == F.col("_first")).drop("_first")
    fits = period_fits(benign.where("not _held"), malware, features, period, "_fold", folds, l2)
    fitted = {p for p, k, _ in fits if k == PRIOR}
    tested = sorted(r[0] for r in unseen.select(period).distinct().collect() if r[0] and r[0] in fitted)
    spark = rows.sparkSession
    fits = [f for f in fits if f[0] in set(tested)]
    table = F.broadcast(small_table(spark, [(p, b) for p, k, b in fits if k == PRIOR], "_period string, _b array<double>"))
    months = F.array(*map(F.lit, tested)).cast("array<string>")
    # One after the other from the intercept on, as in _scores.
    z = sum((F.col(c).cast("double") * F.get("_b", F.lit(i)) for i, c in enumerate(features, 1)), F.get("_b", F.lit(0)))
    prob = F.round(F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)), 9)
    in_every = benign.where("_held").withColumn("_month", F.explode(months)).drop(period).withColumnRenamed("_month", period).select(*benign.columns)
    test = in_every.unionByName(unseen.where(F.col(period).isin(tested)))
    test = test.join(table, F.col("_period") == F.col(period)).withColumn("prob", prob).drop("_period", "_b")
    limits = training_limits(benign.where("not _held").unionByName(malware), features, period, "_fold", tested, fits, label)
    return test.drop("_held", "_fold").join(F.broadcast(limits), period)


def _scores(batch, features: int, tested: list[str], models: dict):
    """(number of the period, scores, their rows) of a batch (x0, x1, ..., label, fold, period) under the fit of each period without the row's fold, for rows known before it."""
    from bisect import bisect_right

    import pyarrow.compute as pc

    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(features + 1)]
    x, label = columns[:features], columns[features]
    known = pc.fill_null(batch.column(features + 2), "").dictionary_encode()
    first = np.array([bisect_right(tested, p) for p in known.dictionary.to_pylist()], np.int64)[known.indices.to_numpy(zero_copy_only=False)]
    first[label == 0] = 0
    fold = pc.fill_null(batch.column(features + 1), PRIOR).to_numpy(zero_copy_only=False)
    for k in np.unique(fold[fold != PRIOR]).tolist():
        own = np.flatnonzero(fold == k)
        own = own[np.argsort(first[own], kind="stable")]
        upto = np.searchsorted(first[own], np.arange(len(tested)), "right")
        parts = [c[own] for c in x]
        for i, n in enumerate(upto.tolist()):
            b = models.get((i, k))
            if b is not None and n:
                z = np.full(n, b[0])
                for c, w in zip(parts, b[1:]):
                    z += c[:n] * w
                # Not a number is above all numbers, as in Spark.
                z = np.where(np.isnan(z), 1.0, np.clip(z, 0.0, 1.0))
                yield i, np.rint(z * 1e9) / 1e9, label[own[:n]]


def training_limits(rows: DataFrame, features: list[str], period: str, fold: str, tested: list[str], fits: list[tuple], label: str = "label") -> DataFrame:
    """period, t_f05, t_fpr1, t_fpr05, t_strict of each tested period, from its training rows: all benign ones, and malware of earlier periods.

    The driver holds at most metrics.BINS + 92 counts a period.
    """
    spark, d = rows.sparkSession, len(features)
    number = {p: i for i, p in enumerate(tested)}
    models = {(number[p], k): b for p, k, b in fits if k != PRIOR}
    grid = metrics.steps_between()
    bins, cells = metrics.BINS, len(grid) + 1
    columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = rows.select(*columns, F.col(label).cast("int").alias("label"), F.col(fold).alias("fold"), F.col(period).alias("period"))

    def count(batches):
        import pyarrow as pa

        found = np.zeros((len(tested), bins + 2 * cells), np.int64)
        for batch in batches:
            for i, score, y in _scores(batch, d, tested, models):
                good = y == 0
                reached = np.searchsorted(grid, score, "right")
                found[i, :bins] += np.bincount(np.minimum((score[good] * bins).astype(np.int64), bins - 1), minlength=bins)
                found[i, bins : bins + cells] += np.bincount(reached[good], minlength=cells)
                found[i, bins + cells :] += np.bincount(reached[~good], minlength=cells)
        i, slot = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(slot), pa.array(found[i, slot])], names=["i", "slot", "n"])

    counted = [(tested[r["i"]], r["slot"], r["n"]) for r in rows.mapInArrow(count, "i long, slot long, n long").groupBy("i", "slot").agg(F.sum("n").alias("n")).collect()]
    reach = [(p, (at - bins) % cells, n if at >= bins + cells else 0, n if at < bins + cells else 0) for p, at, n in counted if at >= bins]
    reach = small_table(spark, reach, f"`{period}` string, reached long, p long, n long").groupBy(period, "reached").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    limits = metrics.best_of_cells(reach, period).withColumnRenamed("threshold", "t_f05")
    counts = small_table(spark, [c for c in counted if c[1] < bins], f"`{period}` string, bin long, n long")
    rates = {"t_fpr1": 0.01, "t_fpr05": 0.005, "t_strict": 0.001}
    holds = [(name, r[period], r["bin"], r["at"]) for name, rate in rates.items() for r in metrics.holding_bins(counts, period, rate).collect()]
    wanted = {i: np.array(sorted({h[2] for h in holds if h[1] == p}), np.int64) for p, i in number.items()}

    def rank(batches):
        import pyarrow as pa

        for batch in batches:
            found: dict[int, list] = {}
            for i, score, y in _scores(batch, d, tested, models):
                score = score[y == 0]
                found.setdefault(i, []).append(score[np.isin(np.minimum((score * bins).astype(np.int64), bins - 1), wanted[i])])
            for i, parts in found.items():
                score, n = np.unique(np.concatenate(parts), return_counts=True)
                at = np.minimum((score * bins).astype(np.int64), bins - 1)
                yield pa.RecordBatch.from_arrays([pa.array([tested[i]] * len(n), pa.string()), pa.array(at), pa.array(score), pa.array(n)], names=[period, "bin", "score", "n"])

    within = rows.mapInArrow(rank, f"`{period}` string, bin long, score double, n long").groupBy(period, "bin", "score").agg(F.sum("n").alias("n"))
    sought = small_table(spark, holds, f"_name string, `{period}` string, bin long, at long")
    ranked = within.join(F.broadcast(sought), [period, "bin"])
    upto = F.sum("n").over(W.partitionBy("_name", period).orderBy("score"))
    least = ranked.withColumn("upto", upto).where("upto > at").groupBy(period).pivot("_name", list(rates)).agg(F.min("score") + 1e-9)
    return limits.join(least, period)


def set_metrics(rows: DataFrame, sets: dict[str, Column], thresholds: dict[str, Column], label: str = "label") -> DataFrame:
    """set, at, n, n_mal, recall, precision, fpr, accuracy of scored rows (prob) in overlapping sets at several thresholds, in one pass; undefined rates are null."""
    # Rows are summed as they are, by what they belong to and reach; sets and thresholds meet the sums.
    inside, hits = F.array(*[F.coalesce(c, F.lit(False)) for c in sets.values()]), F.array(*[F.col("prob") >= t for t in thresholds.values()])
    sums = rows.groupBy(F.col(label).alias("label"), inside.alias("inside"), hits.alias("hits")).agg(F.count("*").alias("rows"))
    named = F.filter(F.array(*[F.when(F.get("inside", F.lit(i)), F.lit(n)) for i, n in enumerate(sets)]), lambda s: s.isNotNull())
    at = F.array(*[F.struct(F.lit(n).alias("at"), F.get("hits", F.lit(i)).alias("hit")) for i, n in enumerate(thresholds)])
    each = sums.select("label", "rows", F.explode(named).alias("set"), at.alias("at")).select("label", "rows", "set", F.inline("at"))
    found = metrics.confusion(each, ["set", "at"], F.col("hit"), F.col("label"), None, F.col("rows"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return found.select("set", "at", n.alias("n"), (F.col("tp") + F.col("fn")).alias("n_mal"), "recall", "precision", "fpr", metrics.ratio(F.col("tp") + F.col("tn"), n, None).alias("accuracy"))
