"""Boosted trees against a plain grower, their shares against all orders of columns, and their odd cases."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.operators import boosting

EDGES = {"a": [-1.0, -0.3, 0.2, 0.9], "b": [1.0, 2.0, 3.0], "c": [0.5]}


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 5, 600), rng.integers(0, 2, 600)]).astype(float)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)) | (rng.random(600) < 0.1)
    return x, y.astype(int)


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y = sample
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 5) for i, (r, t) in enumerate(zip(x, y))], "i int, a double, b double, c double, label int, fold int").repartition(5)


def grow(x, y, rounds, depth, rate=0.05, l2=1.0, least=20):
    """Margins after ``rounds`` trees and the splits of each, by trying every edge."""
    margin, trees = np.zeros(len(y)), []
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, node, tree = w * (p - y), w * p * (1 - p), np.zeros(len(y), int), {}
        for level in range(depth):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == n
                best = None
                for j, (name, edges) in enumerate(EDGES.items()):
                    for e in edges:
                        left = own & (x[:, j] <= e)
                        right = own & ~left
                        if left.sum() >= least and right.sum() >= least:
                            gain = round(sum(g[s].sum() ** 2 / (h[s].sum() + l2) * k for s, k in ((left, 1), (right, 1), (own, -1))), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, name, e, left, right)
                if best:
                    tree[n] = best[:3]
                    node[best[3]], node[best[4]] = 2 * n + 1, 2 * n + 2
        for n in np.unique(node):
            if n:
                margin[node == n] += rate * -g[node == n].sum() / (h[node == n].sum() + l2)
        trees.append(tree)
    return margin, trees


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_are_those_of_a_plain_grower(table, sample, depth):
    x, y = sample
    margin, trees = grow(x, y, 3, depth)
    model = boosting.train(table, EDGES, rounds=3, depth=depth, cut_every=2)
    made = {}
    for k, tree, n, _, name, edge, _, gain, _ in model["nodes"]:
        if name:
            made.setdefault(tree, {})[n] = (pytest.approx(gain, abs=1e-6), name, edge)
    assert [made[t] for t in sorted(made)] == trees
    got = {r["i"]: r["margin"] for r in boosting.score(table, model).collect()}
    assert np.allclose([got[i] for i in range(600)], margin, atol=1e-9)


def test_shares_are_the_mean_over_all_orders(table, sample):
    x, _ = sample
    model = boosting.train(table, EDGES, rounds=3, depth=3)
    trees = {}
    for _, tree, n, _, name, edge, value, _, cover in model["nodes"]:
        trees.setdefault(tree, {})[n] = (name, edge, value, cover)

    def expected(nodes, n, row, known):
        name, edge, value, cover = nodes[n]
        if name is None:
            return value
        left, right = 2 * n + 1, 2 * n + 2
        if name in known:
            return expected(nodes, left if row[name] <= edge else right, row, known)
        return sum(nodes[c][3] * expected(nodes, c, row, known) for c in (left, right)) / cover

    rows = boosting.contributions(table.where("i < 25"), model, ["i"]).collect()
    margins = {r["i"]: r["margin"] for r in boosting.score(table.where("i < 25"), model).collect()}
    for i in range(25):
        row = dict(zip(EDGES, x[i]))
        shares = dict.fromkeys(EDGES, 0.0)
        for order in permutations(EDGES):
            for at, name in enumerate(order):
                for nodes in trees.values():
                    shares[name] += (expected(nodes, 0, row, order[: at + 1]) - expected(nodes, 0, row, order[:at])) / 6
        mine = {r["name"]: r["contribution"] for r in rows if r["i"] == i}
        assert all(abs(mine.get(c, 0.0) - shares[c]) < 1e-9 for c in EDGES)
        base = next(r["base"] for r in rows if r["i"] == i)
        assert abs(base + sum(mine.values()) - margins[i]) < 1e-9


def test_folds_grow_together_and_stop(table, sample):
    x, y = sample
    scored, model = boosting.out_of_fold(table, EDGES, "fold", rounds=4, depth=2, patience=1, least=10)
    fold, rows = np.arange(600) % 5, {r["i"]: r for r in scored.collect()}
    assert set(model["best"]) == set("01234") and all(1 <= b <= 4 for b in model["best"].values())
    for k in (0, 3):
        alone = boosting.train(table.where(F.col("fold") != k), EDGES, rounds=model["best"][str(k)], depth=2, least=10)
        want = {r["i"]: r["margin"] for r in boosting.score(table.where(F.col("fold") == k), alone).collect()}
        assert all(abs(rows[i]["margin"] - want[i]) < 1e-9 for i in np.flatnonzero(fold == k).tolist())
    assert boosting.mean_rounds({"a": 61, "b": 62}) == 61 and boosting.mean_rounds(model["best"]) == 50 and boosting.mean_rounds({}) == 50


def test_parameters_of_their_own_for_each_key(table):
    both = table.withColumn("k", F.explode(F.array(F.lit("x"), F.lit("y"))))
    model = boosting.train(both, EDGES, by="k", rounds=2, depth=2, params={"x": {"columns": ["b"]}, "y": {"rate": 0.5, "l2": 9.0}})
    assert {n[4] for n in model["nodes"] if n[0] == "x"} <= {"b", None}
    alone = boosting.train(table, EDGES, rounds=2, depth=2, rate=0.5, l2=9.0)
    bare = lambda n: (*n[1:6], n[6] and pytest.approx(n[6], abs=1e-9), n[7] and pytest.approx(n[7], abs=1e-6), n[8])
    assert [n[1:] for n in model["nodes"] if n[0] == "y"] == [bare(n) for n in alone["nodes"]]


def test_monotone_columns_never_lower_the_score(spark, table):
    model = boosting.train(table, EDGES, rounds=4, depth=3, rate=0.4, least=5, monotone={"a": 1, "b": -1})
    grid = spark.createDataFrame([(float(a), float(b), float(c)) for a in (-2, -0.5, 0, 0.5, 2) for b in range(5) for c in (0, 1)], "a double, b double, c double")
    margin = {(r["a"], r["b"], r["c"]): r["margin"] for r in boosting.score(grid, model).collect()}
    for (a, b, c), m in margin.items():
        assert all(m <= m2 + 1e-12 for (a2, b2, c2), m2 in margin.items() if a2 >= a and b2 <= b and c2 == c)


def test_odd_tables(spark, table):
    one_class = table.withColumn("label", F.lit(1))
    assert boosting.train(one_class, EDGES, rounds=2)["nodes"] == []
    scored = boosting.score(table.withColumn("a", F.lit(None).cast("double")), boosting.train(one_class, EDGES, rounds=2))
    assert {r["margin"] for r in scored.collect()} == {0.0}
    assert boosting.train(table.limit(0), EDGES, rounds=2)["best"] == {}
    nulls = table.withColumn("label", F.when(F.col("i") % 2 == 0, F.col("label")))
    assert boosting.train(nulls, EDGES, rounds=1, depth=1)["nodes"][0][8] == 300
    edges = boosting.quantile_edges(table, ["b", "c"], 8)
    assert edges["b"] == [0.0, 1.0, 2.0, 3.0, 4.0] and edges["c"] == [0.0, 1.0]
