"""Gradient-boosted trees over binned columns as grouped sums; the model is a table of nodes.

A column's bin is the number of its edges below the value, so a split after bin k asks ``value <= edges[k]``. Growing one level
of a tree is one job: gradients and curvatures are added up by node, column and bin (partial sums in the map
stage), running sums over bins give the gain of every split, and only the best split of each node reaches
the driver. ``by`` names a column with the key of a model: the trees of all keys (folds, configurations) grow in the same jobs,
each under its own parameters. Scores stay with the rows, which are written every round (or every ``cut_every``) to cut the lineage.

Objective: logistic loss, second order, penalty l2 on leaf values, leaves of at least ``least`` rows; the class of
label 1 weighs negatives / positives, so the first score is 0. Trees grow level by level to ``depth``. A null value counts as 0. Rows with
a null label take no part. A monotone column (1 or -1) never moves the score against its sense: splits against it are refused, and
children are bounded by the middle of both sides. With a validation column training stops once the average precision of the
rows it marks has not risen for ``patience`` rounds, and trees after the best round go. Equal gains (to 9 decimals): first
column, then smallest edge. A key of one class has no trees and the score 0.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics

NODES = "key string, tree int, node int, depth int, name string, edge double, value double, gain double, cover long"
DEFAULTS = {"rate": 0.05, "l2": 1.0, "least": 20, "columns": None}
SPLIT = "key string, node int, column int, bin int"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver rows that is part of the plan, so that a broadcast of it needs no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields))


def quantile_edges(rows: DataFrame, features: list[str], bins: int = 64) -> dict[str, list[float]]:
    """At most bins - 1 edges a column, at its approximate quantiles: one pass with a bounded sketch a column."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col(c), F.lit(0)).cast("double"), at, 10000).alias(c) for c in features]).first()
    return {c: sorted(set(found[c] or [])) for c in features}


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, which outlives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def values(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def binned(edges: dict[str, list[float]]) -> Column:
    """The bins of all columns as one array."""
    def bin_(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda e: x > e)) if edges[c] else F.lit(0)

    return F.array(*map(bin_, edges))


def _best_splits(rows: DataFrame, open_nodes: DataFrame, senses: DataFrame) -> list:
    """The best split of each open node: column, bin, gain, the values and rows of both sides, and the column's sense."""
    cells = rows.select("key", "node", "g", "h", F.posexplode("bins").alias("column", "bin")).groupBy("key", "node", "column", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")
    )
    whole = W.partitionBy("key", "node", "column")
    sides = cells.withColumns({f"l{c}": F.sum(c).over(whole.orderBy("bin")) for c in "ghn"} | {f"t{c}": F.sum(c).over(whole) for c in "ghn"} | {"later": F.lead("bin").over(whole.orderBy("bin"))})
    sides = sides.where("later is not null").withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"})
    sides = sides.join(F.broadcast(open_nodes), ["key", "node"]).join(F.broadcast(senses), "column", "left")

    def value(s: str) -> Column:
        return F.least(F.greatest(-F.col(f"{s}g") / (F.col(f"{s}h") + F.col("l2")), F.col("low")), F.col("high"))

    def worth(s: str) -> Column:
        return -(2 * F.col(f"{s}g") * F.col(f"v{s}") + (F.col(f"{s}h") + F.col("l2")) * F.col(f"v{s}") * F.col(f"v{s}"))

    sides = sides.withColumns({f"v{s}": value(s) for s in "lrt"}).withColumn("gain", F.round(worth("l") + worth("r") - worth("t"), 9))
    fits = sides.where("ln >= least and rn >= least and gain > 0 and (columns is null or array_contains(columns, column)) and (sense is null or sense * (vr - vl) >= 0)")
    first = F.row_number().over(W.partitionBy("key", "node").orderBy(F.desc("gain"), "column", "bin"))
    return fits.withColumn("first", first).where("first = 1").select("key", "node", "column", "bin", "gain", "vl", "vr", "ln", "rn", "sense").collect()


def _walked(rows: DataFrame, splits: dict, levels: int) -> DataFrame:
    """rows with the node that the splits lead to, one broadcast join a level."""
    rows = rows.withColumn("node", F.lit(0))
    for level in range(levels):
        own = [(k, n, s["column"], s["bin"]) for (k, n), s in splits.items() if 2**level - 1 <= n < 2 ** (level + 1) - 1]
        if own:
            table = small_table(rows.sparkSession, own, SPLIT)
            onward = F.when(F.col("column").isNull(), F.col("node")).when(F.get("bins", F.col("column")) <= F.col("bin"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
            rows = rows.join(F.broadcast(table), ["key", "node"], "left").withColumn("node", onward).drop("column", "bin")
    return rows


def _grow(rows: DataFrame, open_: dict, senses: DataFrame, depth: int) -> tuple[dict, dict]:
    """One tree for every open key: its splits, and the values (before the rate) and rows of its nodes, by (key, node)."""
    spark = rows.sparkSession
    bounds = {(k, 0): (float("-inf"), float("inf")) for k in open_}
    splits, made, at = {}, {}, list(bounds)
    for level in range(depth):
        table = [(k, n, float(open_[k]["l2"]), int(open_[k]["least"]), open_[k]["columns"], *bounds[k, n]) for k, n in at]
        table = small_table(spark, table, "key string, node int, l2 double, least int, columns array<int>, low double, high double")
        at = []
        for s in _best_splits(_walked(rows, splits, level), table, senses):
            k, n = s["key"], s["node"]
            (low, high), middle = bounds[k, n], (s["vl"] + s["vr"]) / 2
            below, above = (low, min(high, middle)), (max(low, middle), high)
            bounds[k, 2 * n + 1], bounds[k, 2 * n + 2] = {1: (below, above), -1: (above, below)}.get(s["sense"], ((low, high),) * 2)
            made[k, 2 * n + 1], made[k, 2 * n + 2] = (s["vl"], s["ln"]), (s["vr"], s["rn"])
            splits[k, n] = s
            at += [(k, 2 * n + 1), (k, 2 * n + 2)]
        if not at:
            break
    return splits, made


def train(
    rows: DataFrame, edges: dict[str, list[float]], label: str = "label", by: str | None = None, valid: str | None = None, rounds: int = 50, depth: int = 3,
    patience: int = 50, params: dict[str, dict] | None = None, monotone: dict[str, int] | None = None, cut_every: int = 1, **common,
) -> dict:
    """A model: ``nodes`` (rows of NODES; a leaf has no name), ``names`` of its columns, and ``best``, the number of rounds of each key ('all' without ``by``).

    edges: the columns and their edges. params: key -> any of rate, l2, least and columns (names the key's trees may split on); ``common`` sets them for all keys.
    """
    spark, names = rows.sparkSession, list(edges)
    state = written(rows.where(F.col(label).isNotNull()).select(
        (F.col(by).cast("string") if by else F.lit("all")).alias("key"), F.col(label).cast("int").alias("label"),
        (F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)).alias("held"), binned(edges).alias("bins"), F.lit(0.0).alias("score"),
    ))
    counts = {r["key"]: (r["p"], r["n"]) for r in state.where("not held").groupBy("key").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}
    best, nodes, open_ = dict.fromkeys(counts, 0), [], {}
    for k, (p, n) in counts.items():
        own = DEFAULTS | common | (params or {}).get(k, {})
        if 0 < p < n:
            open_[k] = own | {"columns": None if own["columns"] is None else [names.index(c) for c in own["columns"]], "ap": -1.0, "since": 0}
    weights = F.broadcast(small_table(spark, [(k, (n - p) / max(p, 1)) for k, (p, n) in counts.items()], "key string, weight double"))
    senses = small_table(spark, [(names.index(c), s) for c, s in (monotone or {}).items()], "column int, sense int")
    for tree in range(rounds):
        if not open_:
            break
        live = state.where(F.col("key").isin(list(open_)))
        p, w = 1 / (1 + F.exp(-F.col("score"))), F.when(F.col("label") == 1, F.col("weight")).otherwise(1.0)
        fitting = live.where("not held").join(weights, "key").select("key", "bins", (w * (p - F.col("label"))).alias("g"), (w * p * (1 - p)).alias("h"))
        splits, made = _grow(fitting, open_, senses, depth)
        leaves = {}
        for (k, n), s in splits.items():
            nodes.append((k, tree, n, (n + 1).bit_length() - 1, names[s["column"]], edges[names[s["column"]]][s["bin"]], None, s["gain"], s["ln"] + s["rn"]))
        for (k, n), (v, cover) in made.items():
            if (k, n) not in splits:
                leaves[k, n] = open_[k]["rate"] * v
                nodes.append((k, tree, n, (n + 1).bit_length() - 1, None, None, leaves[k, n], None, cover))
        open_ = {k: of for k, of in open_.items() if (k, 0) in splits}
        if not open_:
            break
        table = small_table(spark, [(k, n, v) for (k, n), v in leaves.items()], "key string, node int, value double")
        moved = _walked(state, splits, depth).join(F.broadcast(table), ["key", "node"], "left")
        state = moved.select("key", "label", "held", "bins", (F.col("score") + F.coalesce("value", F.lit(0.0))).alias("score"))
        state = written(state) if (tree + 1) % cut_every == 0 else state
        if valid:
            found = {r["key"]: r["ap"] for r in precisions(state.where(F.col("held") & F.col("key").isin(list(open_)))).collect()}
            for k, of in list(open_.items()):
                # Without positives among the held rows there is nothing to stop by.
                if (found.get(k) or 0.0) > of["ap"] + 1e-12 or found.get(k) is None:
                    of["ap"], of["since"], best[k] = found.get(k) or 0.0, 0, tree + 1
                else:
                    of["since"] += 1
                    if of["since"] >= patience:
                        open_.pop(k)
        else:
            best |= dict.fromkeys(open_, tree + 1)
    return {"nodes": [n for n in nodes if n[1] < best[n[0]]], "names": names, "best": best}


def precisions(rows: DataFrame) -> DataFrame:
    """key, ap: the average precision of the scores (margins) of each key, over distinct scores; null without positives."""
    steps = rows.groupBy("key", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    over = W.partitionBy("key").orderBy(F.desc("score"))
    precision = F.sum("p").over(over) / F.sum("n").over(over)
    return steps.withColumn("precision", precision).groupBy("key").agg(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p")).alias("ap"))


def mean_rounds(best: dict, floor: int = 50) -> int:
    """The whole part of the mean of the keys' rounds, ``floor`` at least: the rounds of a final fit."""
    return max(int(sum(best.values()) / len(best)) if best else 0, floor)


def node_table(spark: SparkSession, model: dict) -> DataFrame:
    return small_table(spark, model["nodes"], NODES)


def importance(nodes: DataFrame, size_features: list[str], top: int = 15) -> DataFrame:
    """name, gain, place of the columns with the greatest total gain, and whether a size column is among the first two (leak)."""
    total = nodes.where("name is not null").groupBy("name").agg(F.sum("gain").alias("gain"))
    placed = total.withColumn("place", F.row_number().over(W.orderBy(F.desc("gain"), "name")))
    leak = placed.where("place <= 2").agg(F.coalesce(F.bool_or(F.col("name").isin(size_features)), F.lit(False)).alias("leak"))
    return placed.where(F.col("place") <= top).join(F.broadcast(leak))


def score(rows: DataFrame, model: dict, by: str | None = None) -> DataFrame:
    """rows with ``margin`` and ``prob``. The trees of a key are one broadcast row of arrays, walked without a shuffle; a key without trees has margin 0."""
    spark, at = rows.sparkSession, {c: i for i, c in enumerate(model["names"])}
    trees: dict = {}
    for k, tree, n, _, name, edge, value, _, _ in model["nodes"]:
        trees.setdefault(k, {}).setdefault(tree, {})[n] = (at.get(name, -1), edge or 0.0, value or 0.0)
    packed, depth = [], 0
    for k, own in trees.items():
        listed = []
        for nodes in own.values():
            size = max(nodes) + 1
            depth = max(depth, size.bit_length() - 1)
            listed.append(tuple([nodes.get(n, (-1, 0.0, 0.0))[i] for n in range(size)] for i in range(3)))
        packed.append((k, listed))
    table = spark.createDataFrame(packed, "_key string, _trees array<struct<column: array<int>, edge: array<double>, value: array<double>>>")
    x = F.col("_x")

    def leaf(t: Column) -> Column:
        def onward(n: Column, _: Column) -> Column:
            return F.when(F.get(t["column"], n) < 0, n).when(F.get(x, F.get(t["column"], n)) <= F.get(t["edge"], n), 2 * n + 1).otherwise(2 * n + 2)

        return F.get(t["value"], F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), onward))

    key = F.col(by).cast("string") if by else F.lit("all")
    rows = rows.withColumns({"_k": key, "_x": values(model["names"])}).join(F.broadcast(table), F.col("_k") == F.col("_key"), "left")
    margin = F.aggregate(F.coalesce("_trees", F.array().cast(table.schema["_trees"].dataType)), F.lit(0.0), lambda s, t: s + leaf(t))
    rows = rows.withColumn("margin", margin).drop("_k", "_key", "_x", "_trees")
    return rows.withColumn("prob", 1 / (1 + F.exp(-F.col("margin"))))


def _leaf_shares(model: dict) -> tuple[list, dict]:
    """(key, conditions, shares) of every leaf, and the mean margin of each key.

    conditions: column place, low and high of each column on the leaf's path. shares: for each set of met
    conditions, as a mask, the Shapley share of each of those columns in the leaf's value, where a column that is left out is
    met as often as training rows went that way.
    """
    trees: dict = {}
    for k, tree, n, _, name, edge, value, _, cover in model["nodes"]:
        trees.setdefault((k, tree), {})[n] = (name, edge, value, cover)
    at, leaves, base = {c: i for i, c in enumerate(model["names"])}, [], dict.fromkeys(model["best"], 0.0)
    for (k, _), nodes in trees.items():
        for n, (name, _, value, cover) in nodes.items():
            if name is not None:
                continue
            path, share, child = {}, {}, n
            while child:
                parent = (child - 1) // 2
                column, edge, _, whole = nodes[parent]
                low, high = path.get(column, (float("-inf"), float("inf")))
                path[column] = (low, min(high, edge)) if child % 2 else (max(low, edge), high)
                share[column] = share.get(column, 1.0) * nodes[child][3] / whole
                child = parent
            columns, m = list(path), len(path)
            base[k] += value * cover / nodes[0][3]
            phi = []
            for mask in range(1 << m):
                met, row = [mask >> i & 1 for i in range(m)], []
                for i in range(m):
                    others, total = [j for j in range(m) if j != i], 0.0
                    for size in range(m):
                        for known in combinations(others, size):
                            part = factorial(size) * factorial(m - size - 1) / factorial(m)
                            for j in others:
                                part *= met[j] if j in known else share[columns[j]]
                            total += part
                    row.append(value * total * (met[i] - share[columns[i]]))
                phi.append(row)
            leaves.append((k, [(at[c], *path[c]) for c in columns], phi))
    return leaves, base


def contributions(rows: DataFrame, model: dict, ids: list[str], by: str | None = None) -> DataFrame:
    """ids, name, contribution, base: exact Shapley shares of each column in the margin, which are the margin less ``base`` in sum.

    Every row meets every leaf of its key's trees in one broadcast join; partial sums come before the shuffle. Columns no tree asks for have no row.
    """
    spark = rows.sparkSession
    leaves, base = _leaf_shares(model)
    table = spark.createDataFrame(leaves, "_key string, _if array<struct<column: int, low: double, high: double>>, _phi array<array<double>>")
    means = spark.createDataFrame(list(base.items()), "_key string, base double")
    names = F.array(*map(F.lit, model["names"]))
    key = F.col(by).cast("string") if by else F.lit("all")
    met = rows.select(*ids, key.alias("_key"), values(model["names"]).alias("_x")).join(F.broadcast(table), "_key")
    bit = F.transform("_if", lambda c, i: F.when((F.get("_x", c["column"]) > c["low"]) & (F.get("_x", c["column"]) <= c["high"]), F.pow(F.lit(2), i).cast("int")).otherwise(0))
    share = F.arrays_zip(F.col("_if.column").alias("column"), F.get("_phi", F.aggregate(bit, F.lit(0), lambda a, b: a + b)).alias("phi"))
    parts = met.select(*ids, "_key", F.explode(share).alias("s")).groupBy(*ids, "_key", F.get(names, F.col("s.column")).alias("name")).agg(F.sum("s.phi").alias("contribution"))
    return parts.join(F.broadcast(means), "_key").drop("_key")


def out_of_fold(rows: DataFrame, edges: dict[str, list[float]], fold: str, folds: int = 5, label: str = "label", **how) -> tuple[DataFrame, dict]:
    """rows with margin and prob under the model of the other folds, stopped by the fold itself; and the models, all grown in the same jobs."""
    dealt = rows.withColumn("_fit", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_own", F.col("_fit") == F.col(fold))
    model = train(dealt, edges, label, by="_fit", valid="_own", **how)
    return score(rows, model, by=fold), model
