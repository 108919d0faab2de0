"""Logistic regression by Newton's method from bounded sums: calibrators, balanced heads, out-of-fold chances.

A pass over the rows adds up the gradient and X'WX, (d + 1)(d + 4) / 2 numbers a fit whatever the rows, and the driver solves a
system of d + 1 unknowns. ``by`` names a column with the key of a fit: all fits (folds, configurations, periods) share
each pass, and rows that serve several are repeated where they lie, before the sums. Features are columns, summed in the JVM,
or one array column, summed as matrices in Arrow batches. Rows with a null label or feature take no part.
The penalty is l2 / 2 times the squared coefficients, the intercept free; weights of ``balanced`` fits are n / (2 n of the class).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def standardise(rows: DataFrame, vector: str) -> dict:
    """Mean and population deviation (1 where it is 0) of each component of an array column, one row a component."""
    found = rows.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).orderBy("at").collect()
    return {"mean": [r["mean"] for r in found], "dev": [r["dev"] or 1.0 for r in found]}


def scaled(vector: str, scale: dict) -> Column:
    mean, dev = (F.array(*map(F.lit, scale[k])) for k in ("mean", "dev"))
    return F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), mean, lambda x, m: x - m), dev, lambda x, d: x / d)


def chance(features: list[str], coef: list, intercept: float) -> Column:
    return 1 / (1 + F.exp(-reduce(lambda z, t: z + t[0] * F.col(t[1]), zip(coef, features), F.lit(float(intercept)))))


def vector_chance(vector: str, coef: list, intercept: float) -> Column:
    z = F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, coef)), lambda x, b: x * b), F.lit(float(intercept)), lambda s, t: s + t)
    return 1 / (1 + F.exp(-z))


def _column_sums(rows: DataFrame, features: list[str], state: dict) -> dict:
    """key -> (X'WX, gradient, loss), summed in the JVM: the coefficients come in as a small broadcast table."""
    d = len(features) + 1
    table = rows.sparkSession.createDataFrame([(k, [float(b) for b in s["beta"]], float(s["w1"]), float(s["w0"])) for k, s in state.items()], "_by string, _b array<double>, _w1 double, _w0 double")
    x = [F.lit(1.0), *(F.col(f) for f in features)]
    z = reduce(lambda s, t: s + t, (F.col("_b")[i] * x[i] for i in range(d)))
    rows = rows.join(F.broadcast(table), "_by").withColumn("_z", z).withColumn("_w", F.when(F.col("_y") == 1, F.col("_w1")).otherwise(F.col("_w0")) * F.col("_s"))
    rows = rows.withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
    curve, off = F.col("_w") * F.col("_p") * (1 - F.col("_p")), F.col("_w") * (F.col("_y") - F.col("_p"))
    loss = F.col("_w") * (F.log1p(F.exp(-F.abs("_z"))) + F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_y") * F.col("_z"))
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    found = rows.groupBy("_by").agg(*[F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in upper], *[F.sum(off * x[i]).alias(f"g{i}") for i in range(d)], F.sum(loss).alias("loss")).collect()
    out = {}
    for r in found:
        h = np.zeros((d, d))
        for i, j in upper:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r["_by"]] = (h, np.array([r[f"g{i}"] for i in range(d)]), r["loss"])
    return out


def _vector_sums(rows: DataFrame, vector: str, state: dict) -> dict:
    """The same for an array column: each task adds up matrices and returns one row a key and number."""

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            keys, y, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_by", "_y", "_s"))
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in set(keys.tolist()) & set(state):
                own, of = keys == k, state[k]
                xs, ys = x[own], y[own]
                z = xs @ of["beta"]
                p, w = 1 / (1 + np.exp(-z)), np.where(ys == 1, of["w1"], of["w0"]) * s[own]
                loss = (w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - ys * z)).sum()
                part = np.concatenate([((xs * (w * p * (1 - p))[:, None]).T @ xs).ravel(), xs.T @ (w * (ys - p)), [loss]])
                sums[k] = sums.get(k, 0) + part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(part)), pa.array(np.arange(len(part), dtype="i4")), pa.array(part)], names=["_by", "at", "v"])

    found: dict = {}
    for r in rows.select("_by", "_y", "_s", vector).mapInArrow(run, "_by string, at int, v double").groupBy("_by", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["_by"], {})[r["at"]] = r["v"]
    out = {}
    for k, v in found.items():
        d = len(state[k]["beta"])
        flat = np.array([v[i] for i in range(d * d + d + 1)])
        out[k] = (flat[: d * d].reshape(d, d), flat[d * d : -1], flat[-1])
    return out


def fit(
    rows: DataFrame, features: list[str] | str, label: str = "label", by: str | None = None, weight: str | None = None, balanced: bool = False,
    l2: float = 1.0, steps: int = 50, tolerance: float = 1e-10,
) -> dict:
    """key -> {coef, intercept, n, positives, base_rate, steps, gradient}; without ``by`` the fit itself.

    features: names of columns, or the name of one array column of equal lengths. A Newton step that does not lower the
    penalised loss is halved. A key of one class has coef and intercept None, one without rows does not appear.
    """
    vector = features if isinstance(features, str) else None
    names = [vector] if vector else list(features)
    known = rows.select((F.col(by).cast("string") if by else F.lit(ALL)).alias("_by"), F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_s"),
                        *[F.col(c).cast("array<double>" if vector else "double").alias(c) for c in names]).na.drop()
    width = F.max(F.size(vector)) if vector else F.lit(len(names))
    counts = known.groupBy("_by").agg(F.count("*").alias("n"), F.sum("_y").alias("p"), F.sum("_s").alias("s"), F.sum(F.col("_s") * F.col("_y")).alias("sp"), width.alias("d")).collect()
    out, state, last = {}, {}, {}
    for r in counts:
        out[r["_by"]] = {"coef": None, "intercept": None, "n": r["n"], "positives": int(r["p"]), "base_rate": r["p"] / r["n"], "steps": 0, "gradient": None}
        if 0 < r["p"] < r["n"]:
            w1, w0 = (r["s"] / (2 * r["sp"]), r["s"] / (2 * (r["s"] - r["sp"]))) if balanced else (1.0, 1.0)
            state[r["_by"]] = {"beta": np.zeros(r["d"] + 1), "w1": w1, "w0": w0}
    for step in range(1, steps + 1):
        if not state:
            break
        sums = _vector_sums(known, vector, state) if vector else _column_sums(known, names, state)
        for k, (h, g, loss) in sums.items():
            of = state[k]
            free = np.concatenate([[0.0], np.full(len(g) - 1, l2)])
            total = loss + 0.5 * (free * of["beta"] ** 2).sum()
            if k in last and total > last[k][0] * (1 + 1e-12) + 1e-12:
                of["beta"] = (of["beta"] + last[k][1]) / 2
                continue
            gradient = g - free * of["beta"]
            last[k] = (total, of["beta"])
            move = np.linalg.solve(h + np.diag(free) + 1e-12 * np.eye(len(g)), gradient)
            of["beta"] = of["beta"] + move
            out[k] |= {"intercept": float(of["beta"][0]), "coef": of["beta"][1:].tolist(), "steps": step, "gradient": float(np.abs(gradient).max())}
            if np.abs(move).max() < tolerance:
                state.pop(k)
    return out if by else out.get(ALL, {"coef": None, "intercept": None, "n": 0, "positives": 0, "base_rate": None, "steps": 0, "gradient": None})


def out_of_fold(rows: DataFrame, features: list[str], fold: str, folds: int = 5, label: str = "label", **how) -> DataFrame:
    """rows with ``chance``: each fold's rows under the fit of all the others, all fits in the same passes; null where that fit has one class."""
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold)))
    fits = fit(rows.withColumn("_fit", others), features, label, by="_fit", **how)
    made = F.lit(None).cast("double")
    for k, m in fits.items():
        if m["coef"] is not None:
            made = F.when(F.col(fold) == int(k), chance(features, m["coef"], m["intercept"])).otherwise(made)
    return rows.withColumn("chance", made)


def calibrate(rows: DataFrame, logit: Column, share: str = "share", label: str = "label") -> dict:
    """The fitted parts of a calibration from rows that have a share: base_rate, and the calibrators ``both`` and ``classifier_only``."""
    known = rows.where(F.col(share).isNotNull()).withColumn("_logit", logit)
    both, alone = fit(known, ["_logit", share], label), fit(known, ["_logit"], label)
    return {"base_rate": both["base_rate"], "n_heldout": both["n"], "both": {c: both[c] for c in ("coef", "intercept")}, "classifier_only": {c: alone[c] for c in ("coef", "intercept")}}
