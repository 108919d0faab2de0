"""Operator 1: exact length histogram of encoded documents.

Documents are encoded whole, aggregated by token length, and suffix sums over that histogram
answer totals, quantiles and truncated totals for every context limit. The histogram has one row
per distinct length; it is summed before any shuffle. Null and empty texts have length 0 (before
the end marker that ``extra`` counts); an empty table gives an empty histogram. Other columns of
the input are ignored; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encode import encoder


def token_lengths(docs: DataFrame, vocabulary: str, extra: int = 0) -> DataFrame:
    """doc_id, n_tokens of every whole text."""

    from pyspark.sql.types import StructType

    made = StructType.fromDDL("doc_id long, n_tokens long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = [np.diff(ends, prepend=0) for _, ends in encoder(vocabulary).slices(batch.column("text"))]
            n = np.concatenate(n) + extra if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=made.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, made)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L taken as a context limit, by suffix sums in two levels.

    n_docs, docs_over (longer than L), tokens_total (of all), tokens_over (in longer documents),
    tokens_truncated (kept if each document is cut at L), quantile (share of documents <= L).
    Lengths are dealt by blocks of 1,024 so that no task holds the whole histogram.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / 1024)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("mass").alias("bm"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    tail = blocks.select(
        "block",
        F.coalesce(F.sum("bn").over(after), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("bm").over(after), F.lit(0)).alias("tm"),
    )
    total = blocks.agg(F.sum("bn").alias("all_n"), F.sum("bm").alias("all_m"))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    over = h.join(F.broadcast(tail), "block").join(F.broadcast(total)).select(
        "n_tokens", "n_docs", "all_n", "all_m",
        (F.col("tn") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("tm") + F.coalesce(F.sum("mass").over(within), F.lit(0))).alias("tokens_over"),
    )
    return over.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_over",
        F.col("all_m").alias("tokens_total"), "tokens_over",
        (F.col("all_m") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("all_n") - F.col("docs_over")) / F.col("all_n")).alias("quantile"),
    )


def quantile_length(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed."""
    return context_totals(histogram).where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))
