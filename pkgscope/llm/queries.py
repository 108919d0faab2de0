"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, mixing, negatives, neighbours, packing, repeats, runs, secrets, sharding, token_counts, toxicity
from .common import held_out, load, trains

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(load(spark, sf_dir, "documents"), vocabulary())
    histogram = token_counts.length_histogram(lengths)
    from .common import cut

    return token_counts.context_totals(cut(histogram))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(load(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(load(spark, sf_dir, "documents"), 40)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return secrets.scan(docs, secrets.fit(docs)).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents"), vocabulary()))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), 20, 20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.plant(load(spark, sf_dir, "documents"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(load(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_jaccard_join, op3_sharding, op4_toxicity, op5_language_id, op6_secret_scans,
    op7_decontamination, op8_best_fit_packing, op9_nearest_neighbours, op10_substring_dedup, op11_periodic_runs, op12_hard_negatives, op13_source_mix, pipeline,
)}

ORACLE_SQL = {
    "op9_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
    "op13_source_mix": r"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / [5, 2, 1][place % 3 + 1] AS ratio FROM s),
        l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                        / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
        f AS (SELECT ratio, place, level FROM l WHERE ratio > level ORDER BY ratio, place LIMIT 1),
        t AS (SELECT l.source, l.place, l.source_size,
                     CASE WHEN f.place IS NULL OR (l.ratio, l.place) < (f.ratio, f.place) THEN CAST(cap AS DOUBLE) ELSE weight * f.level END AS target
              FROM l LEFT JOIN f ON true),
        r AS (SELECT i, doc_id, size, place, source_size, target, CAST(sum(size) OVER (PARTITION BY place ORDER BY draw, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        m AS (SELECT i, size, CAST(sum(size) OVER (ORDER BY (pass * source_size + upto) / target, place, upto, pass ROWS UNBOUNDED PRECEDING) AS BIGINT) AS past
              FROM r, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
        k AS (SELECT i, CAST(sum(least(size, (SELECT sum(size) FROM d) - (past - size))) AS BIGINT) AS taken FROM m WHERE past - size < (SELECT sum(size) FROM d) GROUP BY i)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN k USING (i)""",
}
