"""Words for values, draws of pairs, reading budgets and chat windows on small cases."""

import random

import duckdb
from pyspark.sql import functions as F

from pkgscope.functions import describe
from pkgscope.operators import augment, reading, splits
from pkgscope.plans import packages, registry


def test_numbers_as_they_are_written(spark):
    rng = random.Random(2)
    xs = [0.0, 1.0, -1.0, 10.0, 9999.0, 10000.0, 99996.0, 123456.0, 0.0001, 0.00001234, 1234.5, 0.5, 100.0, 2e10, 1e-7] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 9) for _ in range(2000)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(describe.short(F.col("x"))).collect()]
    assert got == [f"{x:.4g}" for x in xs]


def test_sentences(spark):
    schema = "feature string, value double, tail string, m double, b double, r double, nm int, nb int"
    rows = [
        ("pkg_has_readme", 0.0, "le", 0.4, 0.1, 4.0, 1546, 12), ("install_has_cmdclass", 1.0, "ge", 0.4, 0.1, 999.0, 1, 1), ("x", 0.0, "le", 0.125, 0.5, 0.25, 10, 1000),
        ("x", 12.5, "ge", 0.005, 0.015, 1.0, 10, 10), ("x", 3.0, "le", 1.0, 0.0, 0.0, 10, 10), ("x", 7.0, "ge", 0.3, 0.2, 1.26, 10, 10),
    ]

    def by_hand(f, v, tail, m, b, r, nm, nb):
        yes = f.startswith(("pkg_has_", "install_has_"))
        had = ("had this" if v else "lacked this") if yes else "had none" if v == 0 and tail == "le" else f"had {'at most' if tail == 'le' else 'at least'} {v:.4g}"
        lean = f"{r:g}x more common among malware" if r >= 1.05 else f"{1 / max(r, 1e-3):.1f}x more common among benign packages" if r <= 0.95 else "about equally common in both"
        seen = ("present" if v else "NOT present") if yes else "0 (none found)" if v == 0 else f"{v:.4g}"
        return seen, f"{m:.0%} of the {nm:,} malicious and {b:.0%} of the {nb:,} benign training packages {had} ({lean})"

    c = {"tail": F.col("tail"), "malicious_share": F.col("m"), "benign_share": F.col("b"), "ratio": F.col("r"), "n_malicious": F.col("nm"), "n_benign": F.col("nb")}
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i")
    got = table.select(describe.observation(F.col("feature"), F.col("value")), describe.training(F.col("feature"), F.col("value"), c)).collect()
    assert [tuple(r) for r in got] == [by_hand(*r) for r in rows]


def test_counts_are_written_in_full(spark, tmp_path):
    rows = [(i, i % 8, p, i % 11, float(i % 50)) for i, p in enumerate([1, 9999, 10000, 10001, 12345, 19010, 99995, 99999, 100000, 1234567, 2**31 + 1, 2**53 + 1, None] * 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = packages.described_evidence(spark, str(tmp_path)).orderBy("l_orderkey").collect()
    assert [tuple(r) for r in got] == con.execute(registry.ORACLE_SQL["described_evidence"] + " ORDER BY l_orderkey").fetchall()


def test_draws_keep_their_rules(spark):
    rows = [(i, f"g{i % 6}", i % 2, i % 20, i % 3, 100 * (i % 30), int(i % 4 == 0), 0, None, 0, 0) for i in range(400)]
    schema = "id long, grp string, label int, pkg_n_files int, pkg_n_py_files int, pkg_loc int, " + ", ".join(f"{c} int" for c in augment.RISKY)
    table = spark.createDataFrame(rows, schema)
    got = augment.draw_pairs(table, "id", "grp", 500, ["a", "b"]).collect()
    assert got and {r["kind"] for r in got} == {"a", "b"} and sorted(got) == sorted(augment.draw_pairs(table.repartition(7), "id", "grp", 500, ["a", "b"]).collect())
    risky = 0
    for r in got:
        host, donor = rows[r["host"]], rows[r["donor"]]
        assert r["host_group"] != r["donor_group"] and host[2] == 0 and 5 <= host[3] <= 300
        assert donor[2] == r["label"] and donor[4] >= 1 and (r["label"] or donor[5] <= 2000)
        risky += r["label"] == 0 and donor[6] > 0
    controls = sum(r["label"] == 0 for r in got)
    assert 0.65 < risky / controls <= 0.95 and len({r["host"] for r in got}) > 50
    assert augment.draw_pairs(table.where("label = 1"), "id", "grp", 50, ["a"]).count() == 0
    assert sorted(r["no"] for r in augment.numbered(table, "id", 3).collect()) == list(range(400))


def test_files_beyond_the_cap(spark):
    rows = [("p", f"{i:03d}", 10, i % 2 == 0) for i in range(30)] + [("q", "only", 5, True)]
    table = spark.createDataFrame(rows, "package string, path string, size long, hit boolean")
    read = lambda **how: [r["path"] for r in reading.beyond_cap(table, "package", [F.col("path")], "path", "size", "hit", **how).orderBy("path").collect()]
    assert read(cap=20, most=5, budget=10**6) == ["020", "022", "024"]
    assert read(cap=20, most=99, budget=11) == ["020", "022"] and read(cap=20, most=99, budget=0) == [] and read(cap=400) == []
    assert read(cap=0, most=1, budget=99) == ["000", "only"]


def test_chat_takes_turns_first_and_silence_out(spark):
    rows = [("c", t, ["user", "assistant", "system"][t % 3], None if t == 17 else f"t{t}") for t in range(20)] + [("d", 0, "user", "")]
    table = spark.createDataFrame(rows, "conv string, turn long, role string, text string")
    got = reading.chat_context(table, "conv", "turn", "role", "text", F.col("turn") % 5 == 1).collect()
    assert sorted((r["turn"], r["newest"]) for r in got if r["part"] == "analysis") == [(6, False), (11, False), (16, True)]
    assert sorted(r["turn"] for r in got if r["part"] == "turn") == [12, 13, 15, 16, 18, 19]
    assert {r["conv"] for r in got} == {"c"}


def test_prints_tell_rounded_features_apart(spark):
    rows = [("a", 1.00004, 2.0), ("b", 1.00001, 2.0), ("c", 1.0001, 2.0), ("d", -0.00001, None), ("e", 0.0, 0.0), ("f", 12.0, 2.0), ("g", 1.0, 22.0)]
    table = spark.createDataFrame(rows, "n string, x double, y double")
    got = {r["n"]: r["p"] for r in table.select("n", splits.behaviour_print(["x", "y"]).alias("p")).collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] and len(set(got.values())) == 5
