"""Evaluation of scored rows (columns score, label) as aggregates and windows.

Ranks over all rows are taken in two levels: scores fall into BINS ranges, counts before each range
come from a small window over the ranges, and only rows of one range share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024


def ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    """a / b; ``undefined`` (0 or null) where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(undefined).cast("double"))


def confusion(rows: DataFrame, keys: list[str], predicted: Column, label: Column, undefined: float | None = 0.0, times: Column | None = None) -> DataFrame:
    """Counts and rates of each key; a row stands for ``times`` rows."""
    count = F.count_if if times is None else lambda c: F.sum(F.when(c, times).otherwise(0))
    counts = rows.groupBy(*keys).agg(
        count(predicted & (label == 1)).alias("tp"), count(predicted & (label == 0)).alias("fp"),
        count(~predicted & (label == 0)).alias("tn"), count(~predicted & (label == 1)).alias("fn"),
    )
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp, undefined), "recall": ratio(tp, tp + fn, undefined),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0), "fpr": ratio(fp, fp + tn, undefined),
    })


def score_steps(rows: DataFrame) -> DataFrame:
    """Distinct scores with their positives and negatives, and those of all greater scores (scores in 0..1)."""
    steps = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    steps = steps.withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)))
    above = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    bins = steps.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    bins = bins.select("bin", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    inside = W.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    return steps.join(F.broadcast(bins), "bin").select(
        "score", "p", "n",
        (F.col("p0") + F.coalesce(F.sum("p").over(inside), F.lit(0))).alias("p_above"),
        (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("n_above"),
    )


def ranking_quality(rows: DataFrame) -> DataFrame:
    """roc_auc (ties count half; null with one class) and average_precision (steps over distinct scores)."""
    s = score_steps(rows)
    wins = F.sum(F.col("n") * (F.col("p_above") + F.col("p") / 2))
    p, n = F.sum("p"), F.sum("n")
    hit = F.col("p_above") + F.col("p")
    precision = hit / (hit + F.col("n_above") + F.col("n"))
    return s.agg(F.try_divide(wins, p * n).alias("roc_auc"), F.try_divide(F.sum(F.col("p") * precision), p).alias("average_precision"))


def fpr_threshold(rows: DataFrame, fpr: float) -> DataFrame:
    """The benign score of rank min(floor(n (1 - fpr)), n - 1) from below, plus 1e-9."""
    s = score_steps(rows.where("label = 0"))
    total = s.agg(F.sum("n").alias("total"))
    at = F.least(F.floor(F.col("total") * (1 - fpr)), F.col("total") - 1)
    below = F.col("total") - F.col("n_above") - F.col("n")
    return s.join(F.broadcast(total)).where((below <= at) & (at < below + F.col("n"))).select((F.col("score") + 1e-9).alias("threshold"))


def f_threshold(rows: DataFrame, beta: float = 0.5, low: float = 0.05, high: float = 0.95, steps: int = 91) -> DataFrame:
    """Best F-beta over evenly spaced thresholds, the least of equal ones. Rows are summed by the number of thresholds they reach first.

    A threshold is i * step + low in doubles, and a score reaches it if it is no less than that double.
    """
    step = (high - low) / (steps - 1)

    def at(i: Column) -> Column:
        return F.when(i >= steps - 1, F.lit(high)).otherwise(i * F.lit(step) + F.lit(low))

    near = F.floor((F.col("score") - low) / step)
    # The quotient may be off by one step; the doubles themselves decide.
    reached = F.aggregate(F.array(*[F.lit(k) for k in (-1, 0, 1)]), F.greatest(near - 1, F.lit(0)).cast("long"), lambda n, k: F.when((near + k >= 0) & (near + k < steps) & (F.col("score") >= at(near + k)), (near + k + 1).cast("long")).otherwise(n))
    cells = rows.withColumn("reached", F.least(reached, F.lit(steps))).groupBy("reached").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    grid = rows.sparkSession.range(steps).withColumnRenamed("id", "i")
    total = cells.agg(F.sum("p").alias("all_p"))
    passed = F.col("reached") > F.col("i")
    tp, fp = F.sum(F.when(passed, F.col("p")).otherwise(0)), F.sum(F.when(passed, F.col("n")).otherwise(0))
    b = beta * beta
    each = grid.join(F.broadcast(cells)).groupBy("i").agg(tp.alias("tp"), fp.alias("fp")).join(F.broadcast(total))
    f = ratio((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * (F.col("all_p") - F.col("tp")) + F.col("fp"))
    return each.select("i", F.round(f, 9).alias("f")).orderBy(F.desc("f"), "i").limit(1).select(at(F.col("i")).alias("threshold"), "f")


def median(rows: DataFrame) -> DataFrame:
    """mid: the exact median of the scores (0..1), the mean of the two middle ones for an even number; null without any.

    Ranges of scores are counted first, and of the ranges that hold the middle only distinct scores are ranked.
    """
    known = rows.where(F.col("score").isNotNull()).select("score", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts = known.groupBy("bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("bin"))
    counts = counts.withColumns({"base": upto - F.col("n"), "total": F.sum("n").over(W.partitionBy())})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = counts.withColumns({"low": low, "high": high}).where((F.col("base") <= F.col("high")) & (F.col("low") < F.col("base") + F.col("n"))).select("bin", "base", "low", "high")
    steps = known.join(F.broadcast(holds), "bin").groupBy("bin", "base", "low", "high", "score").agg(F.count("*").alias("n"))
    past = F.col("base") + F.sum("n").over(W.partitionBy("bin").orderBy("score"))
    steps = steps.withColumn("past", past)
    at = lambda i: F.min(F.when(F.col("past") > i, F.col("score")))
    return steps.agg(((at(F.col("low")) + at(F.col("high"))) / 2).alias("mid"))


def period_f_thresholds(rows: DataFrame, period: str, beta: float = 0.5, low: float = 0.05, high: float = 0.95, steps: int = 91) -> DataFrame:
    """period, threshold: each period's best F-beta over evenly spaced thresholds, the least of equal ones; 0.5 without malware, as no threshold then is better than another.

    Rows are summed by the number of thresholds that they reach; the sums above each threshold follow from at most steps + 1 rows a period.
    """
    reached = F.size(F.filter(F.array(*map(F.lit, steps_between(low, high, steps))), lambda t: t <= F.col("score")))
    cells = rows.groupBy(period, reached.alias("reached")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return best_of_cells(cells, period, beta, low, high, steps)


def steps_between(low: float = 0.05, high: float = 0.95, steps: int = 91) -> list[float]:
    """Evenly spaced thresholds, as doubles."""
    step = (high - low) / (steps - 1)
    return [high if i == steps - 1 else i * step + low for i in range(steps)]


def best_of_cells(cells: DataFrame, period: str, beta: float = 0.5, low: float = 0.05, high: float = 0.95, steps: int = 91) -> DataFrame:
    """period, threshold as of period_f_thresholds, from the malware p and benign rows n of each period that reach a number of thresholds."""
    grid = steps_between(low, high, steps)
    every = cells.groupBy(period).agg(F.sum("p").alias("all_p")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    passed = F.col("reached") > F.col("i")
    sums = every.join(cells, period).groupBy(period, "i", "all_p").agg(F.sum(F.when(passed, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("fp"))
    b = beta * beta
    f = F.round(ratio((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * (F.col("all_p") - F.col("tp")) + F.col("fp")), 9)
    best = sums.withColumn("f", f).groupBy(period).agg(F.min(F.struct((-F.col("f")).alias("f"), "i")).alias("best"), F.max("all_p").alias("all_p"))
    return best.select(period, F.when(F.col("all_p") == 0, F.lit(0.5)).otherwise(F.get(F.array(*map(F.lit, grid)), F.col("best.i"))).alias("threshold"))


def reliability(rows: DataFrame, edges: tuple[float, ...] = (0.05, 0.2, 0.5, 0.8, 0.95)) -> DataFrame:
    """bin, n, observed over uneven bins of the score."""
    bin_ = sum(((F.col("score") >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("observed"))


def sliced_confusion(rows: DataFrame, slices: dict[str, Column], predicted: Column, label: Column) -> DataFrame:
    """slice and its confusion; slices may overlap, so a row is counted once for each that it belongs to."""
    names = F.filter(F.array(*[F.when(inside, name) for name, inside in slices.items()]), lambda s: s.isNotNull())
    return confusion(rows.withColumns({"_hit": predicted, "_label": label}).withColumn("slice", F.explode(names)), ["slice"], F.col("_hit"), F.col("_label"))


def policy_table(rows: DataFrame, rules: dict[str, Column], period: str, balanced: bool = False) -> DataFrame:
    """policy, accuracy, precision, recall, fpr over all periods; balanced weighs benign rows so that each period is an even mix.

    Rows are summed by period and policy first, so the weights meet counts only.
    """
    said = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.coalesce(rule, F.lit(False)).alias("hit")) for name, rule in rules.items()]))
    each = rows.select(period, "label", said.alias("s")).groupBy(period, "s.policy").agg(
        F.count_if(F.col("s.hit") & (F.col("label") == 1)).alias("tp"), F.count_if(~F.col("s.hit") & (F.col("label") == 1)).alias("fn"),
        F.count_if(F.col("s.hit") & (F.col("label") == 0)).alias("fp"), F.count_if(~F.col("s.hit") & (F.col("label") == 0)).alias("tn"),
    )
    w = (F.col("tp") + F.col("fn")) / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)) if balanced else F.lit(1.0)
    sums = each.groupBy("policy").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum(F.col("fp") * w).alias("fp"), F.sum(F.col("tn") * w).alias("tn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    least = F.lit(1e-9)
    return sums.select(
        "policy", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), (tp / F.greatest(tp + fp, least)).alias("precision"),
        (tp / F.greatest(tp + fn, least)).alias("recall"), (fp / F.greatest(fp + tn, least)).alias("fpr"),
    )


def period_thresholds(rows: DataFrame, period: str, rate: float) -> DataFrame:
    """period, threshold: each period's order statistic of benign scores at a false-positive rate (scores in 0..1).

    Ranges of scores are counted first; only rows of the range that holds the threshold are ranked.
    """
    benign = rows.where(F.col("label") == 0).select(period, "score", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    holds = holding_bins(benign.groupBy(period, "bin").agg(F.count("*").alias("n")), period, rate)
    return ranked_thresholds(benign.join(F.broadcast(holds), [period, "bin"]).groupBy(period, "at", "score").agg(F.count("*").alias("n")), period)


def holding_bins(counts: DataFrame, period: str, rate: float) -> DataFrame:
    """period, bin, at: the range of scores that holds each period's threshold, and its rank there, from the benign rows n of each period and range."""
    before = W.partitionBy(period).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(W.partitionBy(period))})
    at = F.least(F.floor(F.col("total") * (1 - rate)), F.col("total") - 1)
    return counts.withColumn("at", at).where((F.col("base") <= F.col("at")) & (F.col("at") < F.col("base") + F.col("n"))).select(period, "bin", (F.col("at") - F.col("base")).alias("at"))


def ranked_thresholds(ranked: DataFrame, period: str) -> DataFrame:
    """period, threshold, from the rows n of each score in the ranges of holding_bins, with the rank looked for."""
    upto = F.sum("n").over(W.partitionBy(period).orderBy("score"))
    return ranked.withColumn("upto", upto).where("upto > at").groupBy(period).agg((F.min("score") + 1e-9).alias("threshold"))


def subgroup_rates(rows: DataFrame, groups: dict[str, Column], thresholds: dict[str, float]) -> DataFrame:
    """metric, rate: share of each group's scores at or above each threshold, null for an empty group; one pass over the rows."""
    rates = {f"{g}_{t}": F.avg(F.when(inside, (F.col("score") >= at).cast("int"))) for g, inside in groups.items() for t, at in thresholds.items()}
    one = rows.agg(*[c.alias(n) for n, c in rates.items()])
    return one.unpivot([], list(rates), "metric", "rate")


def pooled(periods: DataFrame) -> DataFrame:
    """Confusion counts over all periods with recall, true-negative rate and balanced accuracy, the mean of those defined."""
    sums = periods.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"), None)
    tnr = ratio(F.col("tn"), F.col("tn") + F.col("fp"), None)
    return sums.withColumns({"recall": recall, "tnr": tnr, "balanced_accuracy": F.coalesce((recall + tnr) / 2, recall, tnr)})


def percent(rate: Column) -> Column:
    """A rate in per cent with one decimal, a dash where it is undefined."""
    return F.coalesce(F.concat(F.round(rate * 100, 1).cast("decimal(6,1)").cast("string"), F.lit("%")), F.lit("—"))


def recency_weight(rows: DataFrame, date: Column, since: str = "2022-01-01") -> DataFrame:
    """rows with ``weight``: 1, for dated malware up to 2 by the days since a date, over the most of them."""
    days = F.when((F.col("label") == 1) & (date != ""), F.greatest(F.date_diff(F.to_date(date), F.lit(since).cast("date")), F.lit(0)))
    rows = rows.withColumn("_days", days)
    most = rows.agg(F.greatest(F.max("_days"), F.lit(1)).alias("_most"))
    return rows.join(F.broadcast(most)).withColumn("weight", 1 + F.coalesce(F.col("_days") / F.col("_most"), F.lit(0.0))).drop("_days", "_most")
