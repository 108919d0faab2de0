"""Sources, sinks, stores and byte texts on files of their own."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pkgscope.functions import files, results, scan
from pkgscope.plans import registry, tables
from pkgscope.sources import archives, cache, folders, indexes, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_samples_of_both_layouts(spark, tmp_path):
    for name in ("good/p1/1.0/a.zip", "good/p1/1.0/deep/b.zip", "good/p2/c.zip", "good/stray.zip", "bad/p3/2/d.zip", "other/p/1/e.zip", "good/p1/1.0/readme.txt"):
        put(tmp_path / name, "x")
    listed = indexes.files(spark, str(tmp_path), "*.zip")
    got = [tuple(r)[:3] for r in indexes.samples(listed, ["bad", "good"]).orderBy("path").collect()]
    assert got == [("bad", "p3", "2"), ("good", "p1", "1.0"), ("good", "p1", "1.0"), ("good", "p2", "unknown")]
    assert [r["path"] for r in indexes.samples(listed, ["bad", "good"], 2).collect()] == ["bad/p3/2/d.zip", "good/p1/1.0/a.zip"]
    assert {r["size"] for r in listed.collect()} == {1}


def test_ranked_projects(spark, tmp_path):
    put(tmp_path / "top.json", json.dumps({"rows": [{"project": "a", "n": 9}, {"n": 1}, {"project": "b"}]}, indent=1))
    assert [tuple(r) for r in indexes.ranked_projects(spark, str(tmp_path / "top.json")).collect()] == [(1, "a"), (3, "b")]


def test_index_or_records_whichever_hold_more(spark, tmp_path):
    index, base = tmp_path / "index.json", tmp_path / "base"
    assert indexes.load_index(spark, str(index), str(base), "/r")[0].count() == 0
    put(index, json.dumps([{"package": "a", "label": 1, "path": "data/a"}, {"package": "b", "label": 0}], indent=1))
    put(base / "x" / "meta.json", json.dumps({"package": "x", "version": "2", "label": 0, "more": [1]}))
    rows, bad = indexes.load_index(spark, str(index), str(base), "/r")
    assert sorted((r["package"], r["dir"]) for r in rows.collect()) == [("a", "/r/data/a"), ("b", f"{base}/b")] and bad.count() == 0
    put(base / "y" / "meta.json", "{broken")
    put(base / "z" / "meta.json", json.dumps({"package": "z", "path": "p/z"}))
    rows, bad = indexes.load_index(spark, str(index), str(base), "/r")
    assert sorted((r["package"], r["dir"]) for r in rows.collect()) == [("x", f"{base}/x"), ("z", "/r/p/z")]
    assert [r["record"] for r in bad.collect()] == ["{broken"]


def test_advisories(spark, tmp_path):
    def one(name, **fields):
        put(tmp_path / f"{name}.json", json.dumps({"id": name, **fields}, indent=1))

    def hit(*named):
        return [{"package": {"name": n}, "versions": v} for n, v in named]

    one("1", published="2025-03-02T00:00:00Z", modified="2020-01-01", affected=hit(("My_.Pkg", ["1", "2"])))
    one("2", published="", modified="2025-01-05T00:00:00Z", affected=hit(("my-pkg", [])))
    one("3", published="", modified="", affected=hit(("empty", None)))
    one("4", published="2025-07-01", affected=hit(("new", ["3", "4"]), ("Other", None)))
    one("5", published="2025-08-01", affected=hit(("NEW", ["9"]), ("held", ["1"])))
    one("6", published="2025-08-01", affected=[])
    put(tmp_path / "7.json", "{not json")
    read = indexes.advisories(spark, str(tmp_path))
    assert {r["name"]: r["reported"] for r in indexes.report_dates(read).collect()} == {"my-pkg": "2025-01-05", "new": "2025-07-01"}
    held = spark.createDataFrame([("held",), ("my-pkg",)], "name string")
    recent = indexes.recent_reports(read, held, "2025-06-01")
    assert sorted(map(tuple, recent.collect())) == [("Other", None, "2025-07-01"), ("new", "4", "2025-07-01")]
    made = indexes.jobs(recent, spark.createDataFrame([("ok", "live-benign-random")], "name string, `set` string"))
    assert {(r["package"], r["version"], r["label"]) for r in made.collect()} == {("Other", None, 1), ("new", "4", 1), ("ok", "", 0)}


def test_store_grows_once_and_is_checked(spark, tmp_path):
    path, calls = str(tmp_path / "v"), []
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [2.0]), (None, [3.0]), *[(f"k{i}", [1.0]) for i in range(18)], ("none", None)], "key string, x array<double>")

    def embed(todo):
        calls.append(todo.count())
        return todo.where("x is not null").select("key", F.col("x").alias("embedding"))

    assert cache.extend(rows.limit(10), path, embed, 1)["written"] == 8
    assert cache.extend(rows, path, embed, 1) == {"written": 13, "total": 21, "empty": 1}
    assert cache.extend(rows, path, embed, 1) == {"written": 0, "total": 21, "empty": 1}
    assert calls[-1] == 0 and cache.stored(spark, path).count() == 21
    more = spark.createDataFrame([(f"z{i}", None) for i in range(3)], rows.schema)
    with pytest.raises(cache.EmptyVectors, match="4 of 24"):
        cache.extend(more, path, embed, 1)
    assert cache.stored(spark, path).where("key like 'z%'").count() == 3


def test_a_missing_artifact_is_an_empty_table(spark, tmp_path):
    absent = folders.optional(spark, str(tmp_path / "gone"), "name string, score double")
    assert absent.count() == 0 and absent.columns == ["name", "score"]
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["score"] for r in rows.join(absent, "name", "left").collect()] == [None, None]
    spark.createDataFrame([("a", 0.5)], "name string, score double").write.parquet(str(tmp_path / "here"))
    there = folders.optional(spark, str(tmp_path / "here"), "name string, score double")
    assert sorted((r["name"], r["score"]) for r in rows.join(there, "name", "left").collect()) == [("a", 0.5), ("b", None)]


def test_partitions_are_replaced_and_tables_published(spark, tmp_path):
    days, table = str(tmp_path / "days"), str(tmp_path / "table")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, d string"), days, ["d"])
    sinks.write_partitions(spark.createDataFrame([(9, "b"), (8, "c")], "n int, d string"), days, ["d"])
    assert sorted(map(tuple, spark.read.parquet(days).collect())) == [(1, "a"), (2, "a"), (8, "c"), (9, "b")]
    sinks.publish(spark.range(3), table)
    sinks.publish(spark.read.parquet(table).where("id > 0"), table)
    assert sorted(r[0] for r in spark.read.parquet(table).collect()) == [1, 2] and len(list(tmp_path.iterdir())) == 2
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, table)
    assert spark.read.parquet(table).count() == 2


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 0.256), ("a", None), (None, 1.0)], "name string, x double")
    sinks.json_lines(rows, str(tmp_path / "j"))
    assert sorted(map(str, spark.read.json(str(tmp_path / "j")).select("name", "x").collect())) == sorted(map(str, rows.collect()))
    lines = sinks.markdown(rows, {"name": F.col("name"), "x": sinks.percent(F.col("x"))}, ["name"])
    sinks.write_report(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    assert text == "| name | x |\n|---|---|\n| — | 100.0% |\n| a | — |\n| b\\|c | 25.6% |\n"


def test_bytes_to_text(spark):
    rng = random.Random(1)
    parts = [b"a", b"\r", b"\n", b"\r\n", b"\x80", b"\xc3\xa9", b"\xc3", b"\xe2\x82\xac", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\xed\xa0\x80", b"\xff", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\x00"]
    rows = [b"".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(500)] + [b"x" * (2 << 20), b"x" * ((2 << 20) + 1)]
    got = [r[0] for r in spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)], "i int, b binary").orderBy("i").select(files.text_of(F.col("b"))).collect()]
    want = [re.sub("\r\n?", "\n", b.decode("utf-8", "replace")) for b in rows[:-1]] + [None]
    assert got == want
    assert spark.createDataFrame([(None,)], "b binary").select(files.text_of(F.col("b"))).first()[0] is None


def test_texts_about_the_limit(spark, tmp_path):
    sizes = range(tables.TEXT_BYTES - 9, tables.TEXT_BYTES + 2)
    rows = [(6 * i + kind, "\u00e9\n" + "x" * (n - 3)) for i, n in enumerate(sizes) for kind in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = tables.read_texts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.execute(registry.ORACLE_SQL["read_texts"] + " ORDER BY doc_id").fetchall()
    whole = spark.createDataFrame([(bytearray(b"abc"), 2), (bytearray(b"abc"), 3), (bytearray(b"abc"), 4)], "b binary, n int").select(files.text_of(F.col("b"), 3, F.col("n")), files.text_of(F.col("b"), 2))
    assert sorted(map(tuple, whole.collect()), key=str) == [("abc", None), ("abc", None), (None, None)]


def test_lines_end_where_texts_say(spark):
    texts = ["a\r8.8.8.8\rb", "x\r\n9.9.9.9", "\x0b\x0c  \x85 7.7.7.7", "1.1.1.1", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scan.line_hits(F.col("t"))).collect()]
    for text, hits in zip(texts, got):
        want = [i for i, line in enumerate((text or "").splitlines(), 1) if re.search(r"\d\.\d", line)]
        assert [h["line"] for h in hits or []] == want


def test_code_is_blanked_at_every_depth(spark):
    schema = "r struct<package: string, similarity: struct<share: double, matches: array<struct<file: string, query_code: string, known_code: string>>>, file_scan: struct<files: array<struct<path: string, hits: array<struct<line: int, code: string>>>>>>"
    rows = [(("p", (0.5, [("f", "secret", None), None]), ([("a.py", [(1, "secret"), (2, None)]), ("b.py", [])],)),), (("q", None, None),), (("s", (None, None), (None,)),), (None,)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(results.without_code(F.col("r"))).collect()]
    assert "secret" not in str(got)
    assert [m and (m["file"], m["query_code"], m["known_code"]) for m in got[0]["similarity"]["matches"]] == [("f", "", ""), None] and got[0]["similarity"]["share"] == 0.5
    assert [(h["line"], h["code"]) for h in got[0]["file_scan"]["files"][0]["hits"]] == [(1, ""), (2, "")] and got[0]["file_scan"]["files"][1]["hits"] == []
    assert got[1]["similarity"] is None and got[1]["file_scan"] is None and got[2]["similarity"]["matches"] is None


def test_oversize_archives_are_rejects(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "MAX_ARCHIVE", 10)
    put(tmp_path / "large.zip", "x" * 11)
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["error"] == "ValueError: archive of 11 bytes" and rows[0]["content"] is None


def test_jobs_are_stored_once_within_quotas(spark, tmp_path):
    path, schema = str(tmp_path / "jobs"), "package string, version string, `set` string, label int"
    rows = [("a", "1", "s", 0), ("a", "1", "s", 0), ("b", None, "s", 0), ("c", "", "s", 0), ("d", "1", "free", 1), ("e", "1", None, 1)]
    table = spark.createDataFrame(rows, schema)
    assert cache.store_jobs(table, path, {"s": 2}) == {"s": 2, "free": 1, None: 1}
    assert cache.store_jobs(table, path, {"s": 2}) == {"s": 1} and cache.store_jobs(table, path, {"s": 2}) == {}
    assert cache.store_jobs(spark.createDataFrame([("a", "2", "s", 0)], schema), path, {}) == {"s": 1}
    got = [(r["package"], r["version"], r["batch"]) for r in spark.read.schema(cache.HELD).parquet(path).where("`set` = 's'").collect()]
    assert sorted(got, key=str) == [("a", "1", 0), ("a", "2", 2), ("b", None, 0), ("c", "", 1)]
