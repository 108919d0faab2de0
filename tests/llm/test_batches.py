"""Stages of the pipeline meet texts in Arrow batches of bounded bytes."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_batches_of_stages_are_bounded_by_bytes(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.unset(key)
            stage(spark, docs.limit(0), str(tmp_path))
            got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(got) < 2 * corpus_pipeline.BATCH_BYTES and sum(got) > 30_000_000
    finally:
        spark.conf.set(key, before)
