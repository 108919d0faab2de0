"""Nearest vectors by tiles, the exact median and entropies of whole texts against plain Python."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pkgscope.functions import text as T
from pkgscope.operators import metrics, similarity, tiles


def test_neighbours_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "QUERY_BLOCK", 7)
    monkeypatch.setattr(tiles, "INDEX_BLOCK", 13)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 5))
    v[40:60] = v[3]  # a group of copies, so that ties go by id
    rows = [(i, x.tolist(), i % 4) for i, x in enumerate(v)] + [(3, v[8].tolist(), 1), (95, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    got = {}
    for r in similarity.neighbours(table, table.where("vec_id % 9 = 0"), 12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["label"]))
    for q in range(0, 90, 9):
        near = sorted(((-round(float(v[q] @ x), 12), i, y) for i, x, y in rows if i != q and x is not None for x in [np.array(x)]))[:12]
        assert sorted(got[q]) == [(k + 1, i, y) for k, (_, i, y) in enumerate(near)]
    best = {(r["query_id"], r["side"]): r for r in tiles.best(table, table.where("vec_id = 9"), 1, side=F.col("label") == 1).groupBy("query_id", "side").agg(F.max("score").alias("s")).collect()}
    for side in (True, False):
        assert abs(best[9, side]["s"] - max(float(v[9] @ np.array(x)) for i, x, y in rows if x is not None and i != 9 and (y == 1) == side)) < 1e-9
    assert similarity.neighbours(table.limit(0), table, 3).count() == 0 and similarity.neighbours(table, table.limit(0), 3).count() == 0


def test_median_is_exact(spark):
    for scores in ([0.5], [0.1, 0.9], [0.2, 0.2, 0.2, 0.7], [1.0, 0.0, 0.0, 1.0], [i / 997 for i in range(998)], [0.3, None, 0.4, 0.41]):
        known = [s for s in scores if s is not None]
        got = metrics.median(spark.createDataFrame([(s,) for s in scores], "score double")).first()["mid"]
        assert abs(got - float(np.median(known))) < 1e-15
    assert metrics.median(spark.createDataFrame([], "score double")).first()["mid"] is None


def test_entropies(spark):
    texts = [None, "", "a", "aaaa", "ab", "é€😀é", "x" * 1000 + "y", "\n\t "]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.entropies()(F.col("t"))).collect()]
    for t, e in zip(texts, got):
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else None
        assert e is None if want is None else abs(e - want) < 1e-12
