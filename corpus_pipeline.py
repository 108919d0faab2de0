"""A corpus pipeline of five stages over documents; run() writes and rereads each one.

Order: toxic documents go; one document of each near-duplicate class stays; words of benchmark
passages mark documents, and those go; secrets are masked; what is left is packed.
All but the last stage return the columns of documents. Each stage bounds the session's Arrow batches by bytes. Null and empty texts are clean and stay;
repeated rows are copies; an empty table passes through empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pkgscope.llm import decontaminate, jaccard, packing, secrets, toxicity
from pkgscope.llm.common import load, shared_folder
from pkgscope.llm.queries import vocabulary

ORACLE_SQL = None
BATCH_BYTES = 4 << 20


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of about BATCH_BYTES, whatever the length of texts: executors and their workers hold a batch several times over."""

    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return of


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", bounded(toxicity_stage)),
    ("ngram_jaccard_join", bounded(jaccard_stage)),
    ("benchmark_decontamination", bounded(decontamination_stage)),
    ("secret_scans", bounded(secrets_stage)),
    ("best_fit_packing", bounded(packing_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
