"""Monthly retraining against one fit after another in numpy, with undated malware, nulls and months without news."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.operators import metrics, rolling
from pkgscope.plans import models, registry


def fit(x, y, l2=1.0):
    x = np.hstack([np.ones((len(x), 1)), x])
    s = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    return np.linalg.solve((x.T * s) @ x + np.diag([0.0, l2, l2]), x.T @ (s * y))


def prob(b, x):
    return np.round(np.clip(b[0] + x @ b[1:], 0, 1), 9)


def best_f(y, p):
    grid = [0.95 if i == 90 else i * (0.9 / 90) + 0.05 for i in range(91)]
    f = []
    for t in grid:
        tp, fp, fn = (p >= t)[y == 1].sum(), (p >= t)[y == 0].sum(), (p < t)[y == 1].sum()
        f.append(round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 9) if tp else 0.0)
    return grid[int(np.argmax(f))]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(500):
        y = int(rng.random() < 0.4)
        month = [None, "", "2025-01", "2025-02", "2025-03", "2025-05"][rng.integers(0, 6)]
        a, b = float(rng.normal() + y), float(rng.normal() - 0.5 * y)
        out.append((i, f"g{rng.integers(0, 60)}" if y else f"b{i % 90}", month, a, b, y, i % 5))
    return out + [(600, None, "2025-03", 0.0, 0.0, 1, 0), (601, "new", "2025-03", None, 0.0, 1, 0), (602, "new", "2025-03", 9.0, 0.0, None, 0)]


SCHEMA = "i int, grp string, month string, a double, b double, label int, fold int"


def test_scores_and_thresholds_of_each_month(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    got = rolling.rolling_scores(table, ["a", "b"], "grp", "month", F.col("i") % 7 == 0, F.col("fold")).collect()
    good = [r for r in rows if None not in (r[1], r[3], r[4], r[5])]
    ids, x, y = np.array([r[0] for r in good]), np.array([r[3:5] for r in good]), np.array([r[5] for r in good])
    month, fold, group = np.array([r[2] or "" for r in good]), np.array([r[6] for r in good]), np.array([r[1] for r in good])
    held, seen = (y == 0) & (ids % 7 == 0), 0
    for m in ("2025-01", "2025-02", "2025-03", "2025-05"):
        before = (y == 1) & (month < m)
        new = (y == 1) & (month == m) & ~np.isin(group, group[before])
        train = (y == 0) & ~held | before
        mine = {r["i"]: r for r in got if r["month"] == m}
        if not new.any():
            assert not mine
            continue
        seen += 1
        at = new | held
        assert set(mine) == set(ids[at].tolist())
        assert np.allclose([mine[i]["prob"] for i in ids[at].tolist()], prob(fit(x[train], y[train]), x[at]), atol=2e-9)
        oof = np.zeros(len(y))
        for k in range(5):
            own = train & (fold == k)
            oof[own] = prob(fit(x[train & (fold != k)], y[train & (fold != k)]), x[own])
        one, benign = next(iter(mine.values())), np.sort(oof[train & (y == 0)])
        assert abs(one["t_f05"] - best_f(y[train], oof[train])) < 1e-12
        for name, rate in (("t_fpr1", 0.01), ("t_fpr05", 0.005), ("t_strict", 0.001)):
            assert abs(one[name] - 1e-9 - benign[min(int(np.floor(len(benign) * (1 - rate))), len(benign) - 1)]) < 2e-9
    assert seen >= 2


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_training_rows_are_not_repeated_for_each_month(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    got = plan(rolling.rolling_scores(table, ["a", "b"], "grp", "month", F.col("i") % 7 == 0, F.col("fold")))
    assert got.count("Generate ") == 2  # the held rows, which are tested in every month, and the grid of thresholds


def test_sets_and_thresholds_meet_sums(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.7, None), (None, 1)], "prob double, label int")
    found = rolling.set_metrics(rows, {"all": F.lit(True), "some": F.when(F.col("label") == 1, True)}, {"low": F.lit(0.5), "none": F.lit(None).cast("double")})
    assert plan(found).rindex("Aggregate ") > plan(found).rindex("Generate ")
    assert {(r["set"], r["at"], r["n"], r["n_mal"]) for r in found.collect()} == {("all", "low", 2, 1), ("all", "none", 0, 0), ("some", "low", 1, 1), ("some", "none", 0, 0)}


def test_events_that_share_an_id_are_rows_of_their_own(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 4000 or event_id > 7000").withColumn("event_id", F.expr("if(event_id % 100 = 0, event_id div 1000 * 1000, event_id)"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = models.rolling_retrained(spark, str(tmp_path)).groupBy("day").agg(F.count("*"), F.sum("label"), F.max("t_fpr1")).orderBy("day").collect()
    want = con.execute(f"SELECT day, count(*), sum(label)::BIGINT, max(t_fpr1) FROM ({registry.ORACLE_SQL['rolling_retrained']}) GROUP BY day ORDER BY day").fetchall()
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)


def test_no_malware_and_no_rows(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    for part in (table.where("label = 0"), table.limit(0)):
        assert rolling.rolling_scores(part, ["a", "b"], "grp", "month", F.col("i") % 7 == 0, F.col("fold")).count() == 0


def test_sets_overlap_and_empty_sides_are_null(spark):
    rows = spark.createDataFrame([(0.9, 1, "x"), (0.2, 0, "x"), (0.7, 0, "x"), (0.6, 1, "y")], "prob double, label int, s string")
    got = {(r["set"], r["at"]): r for r in rolling.set_metrics(rows, {"all": F.lit(True), "y": F.col("s") == "y", "none": F.lit(False)}, {"low": F.lit(0.5), "high": F.lit(0.95)}).collect()}
    assert set(got) == {(s, t) for s in ("all", "y") for t in ("low", "high")}
    assert got["all", "low"][2:] == (4, 2, 1.0, 2 / 3, 0.5, 0.75) and got["y", "high"][2:] == (1, 1, 0.0, None, None, 0.0)


def test_f_thresholds_of_periods(spark):
    rows = spark.createDataFrame([("a", 0.3, 1), ("a", 0.2, 0), ("b", 0.4, 0), ("c", 0.05, 1), ("c", 1.0, 0)], "m string, score double, label int")
    got = {r["m"]: r["threshold"] for r in metrics.period_f_thresholds(rows, "m").collect()}
    assert abs(got["a"] - 0.21) < 1e-9 and got["b"] == 0.5 and got["c"] == 0.05
