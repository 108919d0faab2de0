"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: df as a Parquet table in the shared folder, which outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table that cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SLICE_BYTES = 1 << 20


def text_slices(batch, text: str):
    """Neighbouring rows of an Arrow batch with about SLICE_BYTES of texts at a time, one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, make: Callable, schema: str, text: str = "text", kept: bool = False) -> DataFrame:
    """df without its text column (unless it is kept), plus columns of ``schema`` that are made from the texts alone.

    ``make()`` runs once a task and returns a function from a list of texts to a list of columns.
    The other columns stay Arrow values, so that a null beside an id changes nothing. A batch is taken
    in slices of bounded size, so that a worker holds the Python values of one slice only.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in df.columns if kept or c != text]
    made = StructType.fromDDL(schema)
    fields = list(to_arrow_schema(made))

    def run(batches):
        import pyarrow as pa

        of = make()
        for batch in (part for whole in batches for part in text_slices(whole, text)):
            columns = [pa.array(x, f.type) for x, f in zip(of(batch.column(text).to_pylist()), fields)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=keep + [f.name for f in fields])

    return df.mapInArrow(run, StructType(df.select(*keep).schema.fields + made.fields))


def share_of(rows: Column, at_most: int, total: int) -> Column:
    """True for about at_most of total rows, chosen by a hash of columns: no sort, no shuffle, and the same rows each time."""
    edge = 1 << 31
    return F.pmod(rows, F.lit(edge)) < F.lit(edge if total <= at_most else edge * at_most // total)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def trains(doc_id: str = "doc_id") -> Column:
    """True for rows that labels may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def text_key(text: str = "text") -> Column:
    """128-bit key of a text; null texts count as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a key, with the number of its rows as ``copies``).

    Keys that hold a thousandth of all rows or more, so at most a thousand, are broadcast: their rows stay
    where they are and no task gets a whole hot group. The others meet in a shuffled join.
    """
    total = facts.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") >= max(1000, total // 1000)
    some = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(some, key).unionByName(rest.join(facts.where(~hot), key, how))
