"""Distances to popular names against brute force."""

import random

from __spark_entry__ import queries
from pkgscope.operators import names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_to_popular_names(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(0, 12)))
    popular, own = [word() for _ in range(40)] + [None], [word() for _ in range(400)] + [None, "a" * 30]
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    got = names.distances(frame(own), frame(popular)).collect()
    known = {p.lower() for p in popular if p is not None}
    assert {r["name"]: r["distance"] for r in got} == {n: min(4, *(edits(n, p) for p in known)) for n in {x.lower() for x in own if x is not None}}
    assert len({r["name"] for r in got}) == len(got)
    assert names.distances(frame(own), frame([])).where("distance <> 4").isEmpty()


def test_typosquat_query_takes_every_name(spark, sf):
    want = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("lower(c_name)").union(spark.read.parquet(f"{sf}/part.parquet").selectExpr("lower(p_name)")).distinct()
    assert queries()["typosquat_names"](spark, sf).count() == want.count()


def test_no_pair_of_names_is_a_row(spark):
    rows = spark.range(100).selectExpr("concat('name', id) as name")
    found = names.distances(rows, rows.limit(50))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_all_lengths_and_letters():
    rng = random.Random(6)
    for many in (2, 4, 300):
        letters = [chr(97 + i) if i < 26 else chr(0x1F600 + i) for i in range(many)] + ["\0"]
        for limit in (1, 2, 3):
            word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
            known = sorted({word(9) for _ in range(rng.randrange(1, 40))} | ({"".join(letters)} if many == 300 else set()))
            own = [word(13) for _ in range(80)] + known[:3] + [k + "z" for k in known[-3:]]
            assert names.nearest(own, known, limit).tolist() == [min(limit + 1, *(edits(n, k) for k in known)) for n in own]
    assert names.nearest(["a"], [], 3).tolist() == [4] and names.nearest([], ["a"], 3).tolist() == []
