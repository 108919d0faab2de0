"""Package archives to one row per member; nothing is ever installed or run.

Archives come as Spark's binaryFile rows (path, content). A member that leaves the archive's root, too
many members or too large a total rejects the whole archive; rejects are rows with an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MEMBERS, MAX_BYTES, MAX_ARCHIVE, MAX_TEXT = 60_000, 2 << 30, 200 << 20, 2 << 20
SCHEMA = "archive string, path string, size long, content binary, error string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The members of all archives; one beyond MAX_ARCHIVE is a reject row, and its content is not read."""
    found = spark.read.format("binaryFile").load(path)
    large = found.where(F.col("length") > MAX_ARCHIVE).select(
        F.col("path").alias("archive"), *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("size", "long"), ("content", "binary"))],
        F.concat(F.lit("ValueError: archive of "), F.col("length").cast("string"), F.lit(" bytes")).alias("error"),
    )
    return unpack(found.where(F.col("length") <= MAX_ARCHIVE).select("path", "content")).unionByName(large)


def _members(content: bytes):
    """(name, declared size, reader) of regular members."""
    import io
    import tarfile
    import zipfile

    data = io.BytesIO(content)
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(data) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, lambda i=i: z.read(i)
    else:
        with tarfile.open(fileobj=data, mode="r:*") as t:
            for m in t.getmembers():
                if m.isfile():
                    yield m.name, m.size, lambda m=m: t.extractfile(m).read()


def _escapes(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":")


def unpack(archives: DataFrame) -> DataFrame:
    def rows_of(path, content):
        try:
            listed = [(n, s) for n, s, _ in _members(content)]
            if len(listed) > MAX_MEMBERS or sum(s for _, s in listed) > MAX_BYTES or any(_escapes(n) for n, _ in listed):
                raise ValueError("unsafe archive")
            for name, size, read in _members(content):
                yield path, name, size, read() if size <= MAX_TEXT else None, None
        except Exception as e:  # any broken archive is a reject row, not a failed job
            yield path, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                part = []
                for row in rows_of(path, content):
                    part.append(row)
                    if len(part) == 64:
                        yield pd.DataFrame(part, columns=["archive", "path", "size", "content", "error"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["archive", "path", "size", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, SCHEMA)
