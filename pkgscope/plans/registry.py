"""Registered queries of the library and their oracle SQL.

Stand-ins for package data: documents as files (source as package), labels as classes, embeddings as
the vector index, events as dated scored rows, conversations as chats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, names, similarity, splits, tiles

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


IPS = r"list_filter(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda x: NOT (starts_with(x,'127.') OR starts_with(x,'0.') OR starts_with(x,'10.') OR starts_with(x,'192.168.') OR starts_with(x,'255.')))"
SIGNALS = f"""SELECT doc_id, CAST(len({IPS}) AS BIGINT) AS n_ips,
 CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '^[0-9a-fA-F]{{40,}}$'))) AS BIGINT) AS n_hex,
 CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '^[A-Za-z0-9+/=_-]{{60,}}$'))) AS BIGINT) AS n_base64,
 CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS BIGINT) AS longest_line,
 CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) AS BIGINT) AS long_lines,
 round((length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / greatest(length(text), 1), 6) AS non_ascii
 FROM documents"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, lines = F.col("text"), T.line_lengths(F.col("text"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.public_ips(text)).cast("long").alias("n_ips"), T.literals(text, T.HEXISH).alias("n_hex"), T.literals(text, T.B64ISH).alias("n_base64"),
        F.array_max(lines).cast("long").alias("longest_line"), F.size(F.filter(lines, lambda n: n > T.PACKED_LINE)).cast("long").alias("long_lines"),
        F.round(T.non_ascii_share(text), 6).alias("non_ascii"),
    )


@query(SIGNALS)
def text_signals(spark, sf_dir):
    return signals(spark, sf_dir)


@query(f"""WITH s AS ({SIGNALS}), r AS (SELECT (longest_line > 500) AS hit, 1 - quality AS label FROM s JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp,
 count(*) FILTER (NOT hit AND label = 0) AS tn, count(*) FILTER (NOT hit AND label = 1) AS fn FROM r)
SELECT tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM c""")
def text_risk_report(spark, sf_dir):
    rows = signals(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")
    found = metrics.confusion(rows, [], F.col("longest_line") > 500, 1 - F.col("quality"))
    return found.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query("""SELECT p_partkey, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS name, left(regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g'), 150) AS slug FROM part""")
def normalise_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.normalise(F.col("p_name")).alias("name"), T.slug(F.col("p_name")).alias("slug"))


@query("""SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '>([^<]+)</a>', 1)) AS link FROM pages) GROUP BY link""")
def link_texts(spark, sf_dir):
    links = load(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(">([^<]+)</a>"), F.lit(1))).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n"))


URL_SQL = r"""regexp_extract_all({0}, 'https?://[^\s"''<>)\]]+')"""


@query(f"SELECT page_id, CAST(len({URL_SQL.format('url')}) + len({URL_SQL.format('html')}) AS BIGINT) AS n_urls FROM pages")
def url_counts(spark, sf_dir):
    count = lambda c: F.regexp_count(c, F.lit(T.URL))
    return load(spark, sf_dir, "pages").select("page_id", (count("url") + count("html")).cast("long").alias("n_urls"))


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""")
def text_entropy(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.entropies()(F.col("text")), 6).alias("entropy"))


SCORED = "(SELECT least(greatest(value / 1000.0::DOUBLE, 0), 1) AS score, CAST(event_type = 'error' AS INTEGER) AS label, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events)"


def scored(spark, sf_dir, scale=1000):
    return load(spark, sf_dir, "events").select(
        F.least(F.greatest(F.col("value") / scale, F.lit(0.0)), F.lit(1.0)).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"),
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query(f"""WITH s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {SCORED} GROUP BY score),
w AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pa,
 coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM s)
SELECT round(CAST(sum(n * (pa + p / 2)) AS DOUBLE) / (sum(p) * sum(n)), 6) AS roc_auc, round(CAST(sum(p * (pa + p) / (pa + p + na + n)) AS DOUBLE) / sum(p), 6) AS average_precision FROM w""")
def ranking_quality(spark, sf_dir):
    return metrics.ranking_quality(scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


@query(f"""SELECT round(score + 1e-9, 9) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM {SCORED} WHERE label = 0)
WHERE r = least(floor(n * (1 - 0.01)), n - 1)""")
def fpr_threshold(spark, sf_dir):
    return metrics.fpr_threshold(scored(spark, sf_dir), 0.01).select(F.round("threshold", 9).alias("threshold"))


@query(f"""SELECT CAST((score >= 0.05)::INT + (score >= 0.2)::INT + (score >= 0.5)::INT + (score >= 0.8)::INT + (score >= 0.95)::INT AS INTEGER) AS bin,
 count(*) AS n, round(avg(label), 6) AS observed FROM {SCORED} GROUP BY 1""")
def reliability_table(spark, sf_dir):
    return metrics.reliability(scored(spark, sf_dir)).withColumn("observed", F.round("observed", 6))


GRID = "CASE WHEN i = 90 THEN 0.95::DOUBLE ELSE i::DOUBLE * ((0.95::DOUBLE - 0.05::DOUBLE) / 90::DOUBLE) + 0.05::DOUBLE END"


@query(f"""WITH g AS (SELECT i, {GRID} AS t FROM range(91) r(i)),
m AS (SELECT i, t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp,
 count(*) FILTER (label = 1) AS p FROM g, {SCORED} GROUP BY i, t)
SELECT t AS threshold, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * (p - tp) + fp, 0), 0), 9) AS f
FROM m ORDER BY f DESC, i LIMIT 1""")
def best_threshold(spark, sf_dir):
    return metrics.f_threshold(scored(spark, sf_dir))


@query(f"""WITH d AS (SELECT day, user_id FROM {SCORED}), f AS (SELECT user_id, min(day) AS first FROM d GROUP BY user_id), p AS (SELECT day, count(*) AS n FROM d GROUP BY day),
t AS (SELECT day, count(*) AS test_rows, count(DISTINCT d.user_id) AS test_groups FROM d JOIN f ON d.user_id = f.user_id AND day = first GROUP BY day)
SELECT p.day, CAST(coalesce(sum(n) OVER (ORDER BY p.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_rows, coalesce(test_rows, 0) AS test_rows, coalesce(test_groups, 0) AS test_groups
FROM p LEFT JOIN t ON p.day = t.day""")
def rolling_unseen(spark, sf_dir):
    return splits.rolling_unseen(scored(spark, sf_dir), "user_id", "day")


@query("""WITH r AS (SELECT *, CAST(event_type = 'error' AS INTEGER) AS label, user_id || '/' || strftime(ts, '%Y-%m-%d') AS grp,
 CASE WHEN event_id % 20 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS reported FROM events),
older AS (SELECT DISTINCT grp FROM r WHERE NOT (label = 1 AND reported <> '' AND reported >= '2024-01-15'))
SELECT grp, count(*) AS n FROM r
WHERE label = 1 AND reported <> '' AND reported >= '2024-01-15' AND grp NOT IN (SELECT grp FROM older) GROUP BY grp""")
def split_future(spark, sf_dir):
    """Errors from a day on, in families (a user's events of a day) without any other row; every twentieth row has no date."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = load(spark, sf_dir, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label"), F.concat_ws("/", "user_id", day).alias("grp"),
        F.when(F.col("event_id") % 20 == 0, "").otherwise(day).alias("reported"),
    )
    return splits.split_future(rows, "grp", "reported", "2024-01-15").groupBy("grp").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT source, count(*) AS n, CAST(round_even(avg(1 - quality), 0) AS INTEGER) AS major, md5(source) AS h FROM documents JOIN labels USING (doc_id) GROUP BY source),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY major ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY major) AS share FROM g)
SELECT source, n, CASE WHEN share < 0.15 THEN 'test' WHEN share < 0.30 THEN 'validation' ELSE 'train' END AS split FROM s""")
def deal_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("label", 1 - F.col("quality"))
    return splits.deal_groups(rows, "source", "label")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT source AS name, md5(text) AS p FROM documents), n AS (SELECT DISTINCT a.name AS x, b.name AS y FROM e a JOIN e b USING (p)),
r(x, y) AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x) SELECT x AS name, min(y) AS family FROM r GROUP BY x""")
def merge_families(spark, sf_dir):
    return splits.merge_families(load(spark, sf_dir, "documents").withColumn("print", F.md5("text")), "source", "print")


@query("""SELECT source, count(*) AS files, CAST(sum(lines) AS BIGINT) AS loc, CAST(max(size) AS BIGINT) AS worst, count(*) FILTER (size > 5000) AS large, round(CAST(sum(hits) AS DOUBLE) / (greatest(sum(lines), 1) / 1000), 6) AS hits_per_kloc
FROM (SELECT source, len(string_split(text, chr(10))) AS lines, length(text) AS size, len(regexp_extract_all(text, '[0-9]+')) AS hits FROM documents) GROUP BY source""")
def pool_files(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select("source", F.size(F.split("text", "\n")).alias("lines"), F.length("text").alias("size"), F.regexp_count("text", F.lit("[0-9]+")).alias("hits"))
    return files.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("lines").alias("loc"), F.max("size").cast("long").alias("worst"), F.count_if(F.col("size") > 5000).alias("large"),
        F.round(F.sum("hits") / (F.greatest(F.sum("lines"), F.lit(1)) / 1000), 6).alias("hits_per_kloc"),
    )


@query("""SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < 20000""")
def text_budget(spark, sf_dir):
    # Sizes alone are shuffled; the texts stay where they are.
    files = load(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return splits.running_total(files, "source", "doc_id", "size").where("used < 20000").select("doc_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 8""")
def chat_window(spark, sf_dir):
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("r", last).where("r <= 8").drop("r")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def veto_names(spark, sf_dir):
    veto = load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return load(spark, sf_dir, "supplier").join(veto, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query("""SELECT doc_id, source, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1) LEFT JOIN labels USING (doc_id)""")
def first_of_copies(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    first = docs.groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = docs.select("doc_id", "source").join(first, "doc_id", "left_semi").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return kept.select("doc_id", "source", F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("toxic"))


@query("""SELECT n.n_name, CAST(min(least(levenshtein(lower(n.n_name), lower(r.r_name)), 4)) AS INTEGER) AS distance FROM nation n, region r GROUP BY n.n_name""")
def typosquat_distance(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select("n_name")
    known = F.broadcast(load(spark, sf_dir, "region").select("r_name"))
    near = F.abs(F.length("n_name") - F.length("r_name")) <= 3
    d = T.bounded_levenshtein(F.lower("n_name"), F.lower("r_name"), 3)
    return names.join(known, near, "left").groupBy("n_name").agg(F.least(F.lit(4), F.coalesce(F.min(d), F.lit(4))).cast("int").alias("distance"))


@query("""WITH p AS (SELECT lower(c_name) AS known FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name IS NOT NULL GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 2000),
n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part) WHERE name IS NOT NULL)
SELECT name, CAST(least(coalesce(min(levenshtein(name, known)), 4), 4) AS INTEGER) AS distance FROM n LEFT JOIN p ON abs(length(name) - length(known)) <= 3 GROUP BY name""")
def typosquat_names(spark, sf_dir):
    """Every customer and part name against the 2,000 customers of most orders."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    ordered = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).join(customers, "c_custkey")
    every = customers.select("name").union(load(spark, sf_dir, "part").select("p_name"))
    return names.distances(every, names.most_frequent(ordered, 2000))


@query("""SELECT label, i AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def mean_vectors(spark, sf_dir):
    parts = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return parts.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"""WITH m AS (SELECT median(score) AS mid FROM {SCORED}) SELECT label, round(avg(CAST(score <= mid AS INTEGER)), 6) AS share_le, round(avg(CAST(score >= mid AS INTEGER)), 6) AS share_ge FROM {SCORED}, m GROUP BY label""")
def tail_share(spark, sf_dir):
    rows = scored(spark, sf_dir)
    mid = F.broadcast(metrics.median(rows))
    return rows.join(mid).groupBy("label").agg(F.round(F.avg((F.col("score") <= F.col("mid")).cast("int")), 6).alias("share_le"), F.round(F.avg((F.col("score") >= F.col("mid")).cast("int")), 6).alias("share_ge"))


PAIRS = "(SELECT q.vec_id AS query_id, v.vec_id, v.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"


def unit_vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").withColumn("embedding", similarity.unit(F.col("embedding")))


def neighbours(spark, sf_dir, k):
    index = unit_vectors(spark, sf_dir)
    return similarity.neighbours(index, index.where("vec_id % 50 = 0"), k)


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {PAIRS}) WHERE rank <= 60")
def similar_top(spark, sf_dir):
    return neighbours(spark, sf_dir, 60).select("query_id", "vec_id", "rank")


@query(f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, max(score) OVER (PARTITION BY query_id) AS m FROM {PAIRS}) WHERE r <= 10)
SELECT query_id, round(sum(CASE WHEN label < 5 THEN exp((score - m) / 0.02) ELSE 0 END) / sum(exp((score - m) / 0.02)), 6) AS share FROM t GROUP BY query_id""")
def similar_vote(spark, sf_dir):
    near = neighbours(spark, sf_dir, 10)
    return similarity.vote(near, F.col("label") < 5).select("query_id", F.round("share", 6).alias("share"))


@query(f"""SELECT query_id, round(max(score) FILTER (label < 5), 6) AS malicious_score, arg_max(vec_id, score) FILTER (label < 5) AS malicious_id,
round(max(score) FILTER (label >= 5), 6) AS benign_score, arg_max(vec_id, score) FILTER (label >= 5) AS benign_id FROM {PAIRS} GROUP BY query_id""")
def similar_closest(spark, sf_dir):
    index = unit_vectors(spark, sf_dir)
    found = similarity.closest(tiles.best(index, index.where("vec_id % 50 = 0"), 1, side=F.col("label") < 5), F.col("label") < 5)
    return found.withColumns({c: F.round(c, 6) for c in ("malicious_score", "benign_score")})
