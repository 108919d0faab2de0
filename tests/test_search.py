"""Searches against separate fits, and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.operators import boosting, search


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0.3).astype(int)
    table = spark.createDataFrame([(i, float(a), float(b), int(t), i % 3, i % 4 == 0) for i, ((a, b), t) in enumerate(zip(x, y))], "i int, a double, b double, label int, fold int, extra boolean")
    return x, y, table.unionByName(spark.createDataFrame([(900, None, 1.0, 1, 0, False), (901, 1.0, 1.0, None, 0, False), (902, 1.0, 1.0, 1, None, False)], table.schema))


def precision(y, s):
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    return (hits / np.arange(1, len(y) + 1))[y[order] == 1].mean()


def test_ridge_configurations_are_separate_fits(rows):
    x, y, table = rows
    i = np.arange(300)
    configs = {"one": {"columns": ["b"]}, "two": {"columns": ["b", "a"], "l2": 7.0}, "part": {"columns": ["a", "b"], "rows": F.col("i") % 5 == 0}, "none": {"columns": ["a"], "rows": F.lit(False)}}
    got = {r["config"]: r for r in search.ridge_search(table, configs, "fold", 3, measured=~F.col("extra")).collect()}
    assert got["none"]["ap"] is None and got["two"]["n_columns"] == 2
    for name, use, l2, may in (("one", [1], 1.0, i >= 0), ("two", [1, 0], 7.0, i >= 0), ("part", [0, 1], 1.0, i % 5 == 0)):
        s = np.zeros(300)
        for k in range(3):
            train = may & (i % 3 != k)
            d = np.hstack([np.ones((300, 1)), x[:, use]])
            w = np.where(y == 1, (y[train] == 0).sum() / (y[train] == 1).sum(), 1.0)
            b = np.linalg.solve((d[train].T * w[train]) @ d[train] + np.diag([0.0] + [l2] * len(use)), d[train].T @ (w * y)[train])
            s[i % 3 == k] = (d @ b)[i % 3 == k]
        real = i % 4 != 0
        assert abs(got[name]["ap"] - precision(y[real], s[real])) < 1e-9


def test_boosted_configurations_are_separate_fits(rows):
    x, y, table = rows
    edges = {"a": [-0.5, 0.0, 0.5], "b": [-0.5, 0.0, 0.5]}
    configs = {"plain": {}, "part": {"rows": F.col("i") % 2 == 0, "rate": 0.4, "columns": ["a"]}}
    found, model = search.boosted_search(table.where("i < 300"), edges, configs, "fold", 3, rounds=2, depth=1)
    got = {r["config"]: r for r in found.collect()}
    assert got["plain"]["rounds"] == 50 and set(model["best"]) == {f"{c}|{k}" for c in configs for k in range(3)}
    alone = boosting.train(table.where("i < 300 and fold <> 1 and i % 2 = 0"), {"a": edges["a"]}, rounds=model["best"]["part|1"], depth=1, rate=0.4)
    assert [n[4:6] for n in model["nodes"] if n[0] == "part|1"] == [n[4:6] for n in alone["nodes"]]
    assert 0 < got["part"]["ap"] <= 1


def test_draws_are_fixed_and_from_the_space():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert search.draw(space, 5) == search.draw(space, 5) != search.draw(space, 5, 2)
    assert all(of["a"] in space["a"] and of["b"] in space["b"] for of in search.draw(space, 20).values())
