"""Logistic fits against Newton's method in numpy, and their odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.functions import decision
from pkgscope.operators import logistic


def by_hand(x, y, s=None, l2=1.0):
    x = np.hstack([np.ones((len(x), 1)), np.asarray(x, float)])
    s, free, b = np.ones(len(y)) if s is None else np.asarray(s), np.full(x.shape[1], l2), np.zeros(x.shape[1])
    free[0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (s * p * (1 - p))) @ x + np.diag(free), x.T @ (s * (y - p)) - free * b)
    return b


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, -0.3, 2.0] + rng.logistic(size=400) > 0.4).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y = sample
    return spark.createDataFrame([(i, *map(float, r), [float(v) for v in r], int(t), i % 5, 1.0 + i % 3) for i, (r, t) in enumerate(zip(x, y))],
                                 "i int, a double, b double, c double, v array<double>, label int, fold int, w double").repartition(6)


def test_columns_and_vectors_give_the_same_fit(table, sample):
    x, y = sample
    want = by_hand(x, y)
    for features in (["a", "b", "c"], "v"):
        got = logistic.fit(table, features)
        assert np.allclose([got["intercept"], *got["coef"]], want, atol=1e-9)
        assert got["n"] == 400 and got["gradient"] < 1e-6


def test_balanced_and_weighted(table, sample):
    x, y = sample
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    got = logistic.fit(table, "v", balanced=True)
    assert np.allclose([got["intercept"], *got["coef"]], by_hand(x, y, s), atol=1e-9)
    got = logistic.fit(table, ["a", "b", "c"], weight="w", l2=3.0)
    assert np.allclose([got["intercept"], *got["coef"]], by_hand(x, y, 1.0 + np.arange(400) % 3, 3.0), atol=1e-9)


def test_folds_share_their_passes(table, sample):
    x, y = sample
    rows = logistic.out_of_fold(table, ["a", "b", "c"], "fold").collect()
    fold = np.arange(400) % 5
    for k in range(5):
        b = by_hand(x[fold != k], y[fold != k])
        for r in rows:
            if r["fold"] == k:
                assert abs(r["chance"] - 1 / (1 + np.exp(-(b[0] + x[r["i"]] @ b[1:])))) < 1e-9


def test_scaling_is_that_of_the_population(table, sample):
    x, _ = sample
    scale = logistic.standardise(table, "v")
    assert np.allclose(scale["mean"], x.mean(axis=0)) and np.allclose(scale["dev"], x.std(axis=0))
    got = np.array([r[0] for r in table.orderBy("i").select(logistic.scaled("v", scale)).collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) / x.std(axis=0))


def test_one_class_nulls_constants_and_no_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 1, "one"), (None, 2.0, 0, "one"), (0.0, 2.0, 1, "two"), (1.0, 2.0, 0, "two"), (3.0, None, 0, "gone"), (1.0, 1.0, None, "gone")], "a double, b double, label int, k string")
    fits = logistic.fit(rows, ["a", "b"], by="k")
    assert set(fits) == {"one", "two"} and fits["one"]["coef"] is None and fits["one"]["n"] == 1
    assert np.allclose([fits["two"]["intercept"], *fits["two"]["coef"]], by_hand([[0, 2], [1, 2]], np.array([1, 0])), atol=1e-6)
    assert logistic.fit(rows.limit(0), ["a"])["n"] == 0
    flat = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert logistic.standardise(flat, "v")["dev"] == [1.0, 1.0]


def test_separable_rows_stay_finite(spark):
    rows = spark.createDataFrame([(float(i * 1000), int(i >= 5)) for i in range(10)], "a double, label int")
    got = logistic.fit(rows, ["a"], l2=1e-3)
    assert np.isfinite(got["intercept"]) and got["coef"][0] > 0 and got["gradient"] < 1e-4


def test_calibration_leaves_out_rows_without_share(spark):
    rows = [(0.1 + 0.08 * (i % 10), (i % 4) / 4 if i % 3 else None, int(i % 10 + i % 4 > 6)) for i in range(300)]
    cal = logistic.calibrate(spark.createDataFrame(rows, "score double, share double, label int"), decision.logit(F.col("score")))
    held = [(np.log(p / (1 - p)), s, y) for p, s, y in rows if s is not None]
    x, y = np.array([h[:2] for h in held]), np.array([h[2] for h in held])
    assert np.allclose([cal["both"]["intercept"], *cal["both"]["coef"]], by_hand(x, y), atol=1e-8)
    assert np.allclose([cal["classifier_only"]["intercept"], *cal["classifier_only"]["coef"]], by_hand(x[:, :1], y), atol=1e-8)
    assert abs(cal["base_rate"] - y.mean()) < 1e-12 and cal["n_heldout"] == len(held)


def test_head_of_the_given_vectors(spark, sf):
    from pkgscope.plans import models

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    e, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    y, train = np.array([int(r["label"] < 5) for r in rows]), np.array([r["vec_id"] % 5 != 0 for r in rows])
    x = (e - e[train].mean(axis=0)) / e[train].std(axis=0)
    n, p = train.sum(), y[train].sum()
    b = by_hand(x[train], y[train], np.where(y[train] == 1, n / (2 * p), n / (2 * (n - p))))
    want = dict(zip(ids.tolist(), 1 / (1 + np.exp(-(b[0] + x @ b[1:])))))
    got = models.embedding_head(spark, sf).collect()
    assert len(got) == (~train).sum() and all(abs(r["chance"] - want[r["vec_id"]]) < 2e-6 for r in got)
