"""Archives and similarity on small fixtures."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from pkgscope.operators import similarity, tiles
from pkgscope.sources import archives


def tar_of(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_of(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    rows = [
        ("good.tar.gz", bytearray(tar_of({"p/setup.py": b"x = 1\n", "p/a.py": b""}))), ("good.zip", bytearray(zip_of({"q/b.py": b"y"}))),
        ("bad.tar.gz", bytearray(tar_of({"ok.py": b"", "../evil.py": b"z"}))), ("junk", bytearray(b"not an archive")),
    ]
    got = archives.unpack(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r["archive"], r["path"], r["size"]) for r in got if r["error"] is None} == {
        ("good.tar.gz", "p/setup.py", 6), ("good.tar.gz", "p/a.py", 0), ("good.zip", "q/b.py", 1)
    }
    assert {r["archive"] for r in got if r["error"]} == {"bad.tar.gz", "junk"}


def test_blocks_do_not_change_pairs(spark, monkeypatch):
    """Every pair of a query and another vector, scored, whether all lie in one block or in many."""
    rows = [(i, i % 2, [float(i % 7), float(i % 5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = v.where(F.col("vec_id") % 10 == 0)
    want = sorted((i, j, y, sum(a * b for a, b in zip(x, w))) for i, _, x in rows if i % 10 == 0 for j, y, w in rows if j != i)
    for size in (4096, 9):
        monkeypatch.setattr(tiles, "QUERY_BLOCK", size // 4)
        monkeypatch.setattr(tiles, "INDEX_BLOCK", size)
        assert sorted((r["query_id"], r["vec_id"], r["label"], r["score"]) for r in similarity.neighbours(v, q, 60).collect()) == want
