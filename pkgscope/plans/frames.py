"""Registered queries on joins, sets, splits and reports of scored rows, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sets, similarity, splits
from .registry import SCORED as NARROW
from .registry import load, neighbours, query, scored

SCALE = 150
SCORED = NARROW.replace("1000.0", f"{SCALE}.0")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 200")
def sampled_names(spark, sf_dir):
    return sets.sample(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 200, 42)


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS place FROM n)
SELECT o_custkey, n, CAST(place AS INTEGER) AS place, CASE WHEN place <= 500 THEN 'popular' ELSE 'middle' END AS band FROM r WHERE place <= 1500""")
def rank_bands(spark, sf_dir):
    """Names by use: the first 500 and those up to place 1,500."""
    used = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sets.rank_bands(used, [F.desc("n"), F.col("o_custkey")], {"popular": 500, "middle": 1500})


@query("""SELECT c_name FROM customer EXCEPT (SELECT c_name FROM customer WHERE c_acctbal < 0 UNION SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P')""")
def name_sets(spark, sf_dir):
    """Names that are neither vetoed nor held already."""
    customers = load(spark, sf_dir, "customer")
    held = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.difference(customers.select("c_name"), customers.where("c_acctbal < 0").select("c_name"), customers.join(held, "c_custkey", "left_semi").select("c_name"))


@query("""WITH s AS (SELECT DISTINCT md5(text) AS g, doc_id % 3 AS split FROM documents)
SELECT a.split AS "one", b.split AS other, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.split < b.split GROUP BY a.split, b.split""")
def shared_groups(spark, sf_dir):
    """Texts that two parts of a split by rows share; a split without leaks has none."""
    rows = load(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 3)
    return sets.shared_groups(rows, F.md5("text"), "split")


@query("""SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT 'part', p_name, NULL, p_brand FROM part UNION ALL SELECT 'supplier', s_name, NULL, NULL FROM supplier""")
def stacked_frames(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    parts = load(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    suppliers = load(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return customers.unionByName(parts, allowMissingColumns=True).unionByName(suppliers, allowMissingColumns=True)


@query("""WITH p AS (SELECT 'customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier)
SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) AS place FROM p""")
def interleaved_pools(spark, sf_dir):
    pools = load(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    pools = pools.union(load(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey")))
    return sets.interleaved(pools, "id", 7)


@query("""WITH h AS (SELECT p_partkey AS host, p_brand AS host_group, md5('3:' || p_partkey) AS h FROM part WHERE p_size BETWEEN 5 AND 25),
d AS (SELECT p_partkey AS donor, p_brand AS donor_group, md5('3:' || p_partkey) AS h FROM part WHERE p_size > 25),
hn AS (SELECT *, left(h, 2) AS cell, row_number() OVER (PARTITION BY left(h, 2) ORDER BY h, host) AS r FROM h),
dn AS (SELECT *, left(h, 2) AS cell, row_number() OVER (PARTITION BY left(h, 2) ORDER BY h, donor) AS r FROM d)
SELECT host, host_group, donor, donor_group FROM hn JOIN dn USING (cell, r) WHERE host_group <> donor_group""")
def host_donor_pairs(spark, sf_dir):
    """Hosts of 5 to 25 files, each with a donor of another family."""
    parts = load(spark, sf_dir, "part")
    return sets.pair_up(parts.where("p_size between 5 and 25"), parts.where("p_size > 25"), "p_partkey", "p_brand", 3)


@query("""WITH e AS (SELECT event_id, user_id AS grp, CAST(event_type = 'error' AS INTEGER) AS label FROM events), t AS (SELECT * FROM e WHERE left(md5(CAST(grp AS VARCHAR)), 1) < 'b'),
s AS (SELECT event_id, label, grp AS hg, (grp * 7 + 3) % 150 AS dg FROM e WHERE event_id % 10 = 0)
SELECT label, false AS synthetic, count(*) AS n FROM t GROUP BY label UNION ALL
SELECT label, true, count(*) FROM s WHERE hg IN (SELECT grp FROM t) AND dg IN (SELECT grp FROM t) GROUP BY label""")
def synthetic_rows(spark, sf_dir):
    """Training rows and the synthetic ones that come from training groups on both sides."""
    rows = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("grp"), (F.col("event_type") == "error").cast("int").alias("label"))
    train = rows.where(F.left(F.md5(F.col("grp").cast("string")), F.lit(1)) < "b")
    made = rows.where("event_id % 10 = 0").select("event_id", "label", F.col("grp").alias("host_group"), ((F.col("grp") * 7 + 3) % 150).alias("donor_group"))
    both = sets.with_synthetic(train, made, "grp")
    return both.groupBy("label", F.col("grp").isNull().alias("synthetic")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, l_returnflag FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_returnflag DESC) AS r FROM lineitem)
ON l_partkey = p_partkey AND r = 1""")
def split_by_key(spark, sf_dir):
    """Each key's entry in a table where later entries replace earlier ones."""
    last = sets.last_by_key(load(spark, sf_dir, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_returnflag")
    return load(spark, sf_dir, "part").select("p_partkey").join(last.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left")


@query("SELECT doc_id, url FROM documents JOIN pages ON page_id = doc_id")
def path_lookup(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return load(spark, sf_dir, "documents").select("doc_id").join(pages, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def embedded_subset(spark, sf_dir):
    held = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(held, "doc_id", "left_semi")


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) SELECT o_orderkey, o_orderpriority FROM j WHERE r <= 300""")
def quota_jobs(spark, sf_dir):
    """The first 300 jobs of a set whose package is not held."""
    held = load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    jobs = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return sets.within_quota(jobs, held, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], 300).select("o_orderkey", "o_orderpriority")


@query("""WITH a AS (SELECT l_partkey, o_orderkey, max(l_linenumber) AS version FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= '1999-01-01' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderkey) AS r FROM a WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1))
SELECT l_partkey, o_orderkey, version FROM r WHERE r = 1""")
def recent_reports(spark, sf_dir):
    """Of advisories (orders) since a day: each affected name not in the data, in its first advisory, with the last version listed there."""
    recent = load(spark, sf_dir, "orders").where("o_orderdate >= '1999-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    affected = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(recent, "l_orderkey", "left_semi")
    held = load(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    first = affected.join(held, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", (-F.col("l_linenumber")).alias("v"))).alias("a"))
    return first.select("l_partkey", F.col("a.l_orderkey").alias("o_orderkey"), (-F.col("a.v")).alias("version"))


@query("""SELECT p_brand, p_size, min(p_name) AS archive FROM part WHERE regexp_matches(p_name, '(ring|widget|bolt|gear)$') GROUP BY p_brand, p_size""")
def first_archives(spark, sf_dir):
    """The first archive by name of each release, of names with an allowed suffix."""
    return load(spark, sf_dir, "part").where(F.col("p_name").rlike("(ring|widget|bolt|gear)$")).groupBy("p_brand", "p_size").agg(F.min("p_name").alias("archive"))


@query("""SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda u: regexp_matches(u, '(on|er|tion)$'))[1] AS url FROM pages""")
def picked_source(spark, sf_dir):
    """The first link with an allowed suffix, else null."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.try_element_at(F.filter(links, lambda u: u.rlike("(on|er|tion)$")), F.lit(1)).alias("url"))


DATED = f"(SELECT *, user_id || '/' || (CAST(right(day, 2) AS INTEGER) // 3) AS grp FROM {SCORED})"


@query(f"""WITH m AS (SELECT * FROM {DATED} WHERE label = 1), f AS (SELECT grp, min(day) AS first FROM m GROUP BY grp), d AS (SELECT DISTINCT day FROM m),
tr AS (SELECT d.day, count(m.day) AS train_rows, count(DISTINCT m.grp) AS train_groups FROM d LEFT JOIN m ON m.day < d.day GROUP BY d.day),
te AS (SELECT day, count(*) AS test_rows, count(DISTINCT grp) AS test_groups FROM m JOIN f USING (grp) WHERE day = first GROUP BY day)
SELECT day, train_rows, train_groups, test_rows, test_groups FROM tr JOIN te USING (day)""")
def rolling_sides(spark, sf_dir):
    rows = scored(spark, sf_dir, SCALE)
    grp = F.concat_ws("/", "user_id", F.floor(F.right("day", F.lit(2)).cast("int") / 3).cast("string"))
    return splits.rolling_sides(rows.withColumn("grp", grp), "grp", "day")


@query(f"""WITH g AS (SELECT user_id, count(*) AS n, CAST(round_even(avg(label), 0) AS INTEGER) AS major, md5(CAST(user_id AS VARCHAR)) AS h FROM {SCORED} GROUP BY user_id),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY major ORDER BY h, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY major) AS share FROM g)
SELECT user_id, n, CAST(least(floor(share * 5), 4) AS INTEGER) AS fold FROM s""")
def five_folds(spark, sf_dir):
    return splits.folds(scored(spark, sf_dir), "user_id", "label")


@query(f"""WITH b AS (SELECT day, score, row_number() OVER (PARTITION BY day ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY day) AS n FROM {SCORED} WHERE label = 0),
t AS (SELECT day, score + 1e-9 AS threshold FROM b WHERE r = least(floor(n * (1 - 0.05::DOUBLE)), n - 1))
SELECT day, round(any_value(threshold), 9) AS threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp FROM {SCORED} JOIN t USING (day) GROUP BY day""")
def period_thresholds(spark, sf_dir):
    """Rows against their own period's threshold."""
    rows = scored(spark, sf_dir, SCALE)
    met = rows.join(F.broadcast(metrics.period_thresholds(rows, "day", 0.05)), "day")
    hit = F.col("score") >= F.col("threshold")
    return met.groupBy("day").agg(
        F.round(F.any_value("threshold"), 9).alias("threshold"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"),
    )


SUBGROUPS = {
    "recall": ("label = 1", lambda c: c("label") == 1), "fpr": ("label = 0", lambda c: c("label") == 0),
    "recall_big": ("label = 1 AND user_id >= 100", lambda c: (c("label") == 1) & (c("user_id") >= 100)), "future": ("day > '2025'", lambda c: c("day") > "2025"),
}
CUTS = {"f05": 0.5, "fpr1": 0.7}


@query(" UNION ALL ".join(f"SELECT '{g}_{t}' AS metric, round(avg(CAST(score >= {at} AS INTEGER)) FILTER ({inside}), 6) AS rate FROM {SCORED}" for g, (inside, _) in SUBGROUPS.items() for t, at in CUTS.items()))
def subgroup_rates(spark, sf_dir):
    """Rates of subgroups at two thresholds; an empty one (rows after 2025) has none."""
    found = metrics.subgroup_rates(scored(spark, sf_dir, SCALE), {g: make(F.col) for g, (_, make) in SUBGROUPS.items()}, CUTS)
    return found.withColumn("rate", F.round("rate", 6))


COUNTS = """count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn"""


@query(f"""WITH c AS (SELECT {COUNTS} FROM {SCORED})
SELECT tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS tnr, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def rolling_pooled(spark, sf_dir):
    each = metrics.confusion(scored(spark, sf_dir, SCALE), ["day"], F.col("score") >= 0.5, F.col("label"))
    return metrics.pooled(each).withColumns({c: F.round(c, 6) for c in ("recall", "tnr", "balanced_accuracy")})


@query(f"""WITH c AS (SELECT day, user_id % 50 AS pool, {COUNTS} FROM {SCORED} GROUP BY ALL)
SELECT day, pool, coalesce(CAST(CAST(round(100 * (tp / nullif(tp + fp, 0)), 1) AS DECIMAL(6,1)) AS VARCHAR) || '%', '—') AS "precision",
 coalesce(CAST(CAST(round(100 * (tp / nullif(tp + fn, 0)), 1) AS DECIMAL(6,1)) AS VARCHAR) || '%', '—') AS recall FROM c""")
def formatted_report(spark, sf_dir):
    rows = scored(spark, sf_dir, SCALE).withColumn("pool", F.col("user_id") % 50)
    found = metrics.confusion(rows, ["day", "pool"], F.col("score") >= 0.5, F.col("label"), None)
    return found.select("day", "pool", metrics.percent(F.col("precision")).alias("precision"), metrics.percent(F.col("recall")).alias("recall"))


@query(f"SELECT label, user_id % 10 AS pool, count(*) AS n FROM {SCORED} GROUP BY ALL")
def class_balance(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("label", (F.col("user_id") % 10).alias("pool")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT md5(text) AS g, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS families, max(n) AS largest FROM c""")
def family_sizes(spark, sf_dir):
    sizes = load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("g")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("files"), F.count("*").alias("families"), F.max("n").alias("largest"))


@query("""WITH r AS (SELECT CAST(event_type = 'error' AS INTEGER) AS label, CASE WHEN event_id % 20 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events),
d AS (SELECT *, CASE WHEN label = 1 AND day <> '' THEN greatest(date_diff('day', DATE '2022-01-01', CAST(nullif(day, '') AS DATE)), 0) END AS days FROM r)
SELECT label, day, count(*) AS n, round(avg(1 + coalesce(days / (SELECT greatest(max(days), 1) FROM d), 0)), 6) AS weight FROM d GROUP BY label, day""")
def recency_weights(spark, sf_dir):
    day = F.when(F.col("event_id") % 20 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = load(spark, sf_dir, "events").select((F.col("event_type") == "error").cast("int").alias("label"), day.alias("day"))
    weighed = metrics.recency_weight(rows, F.nullif(F.col("day"), F.lit("")))
    return weighed.groupBy("label", "day").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


# Neighbours of the query vectors, without near copies of those chosen before.
def families_sql(duplicate: float, index: str) -> str:
    score = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
    return f"""WITH RECURSIVE p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, CAST(v.embedding AS DOUBLE[]) AS e, {score} AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND {index}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 60),
g(query_id, rank, chosen) AS (SELECT DISTINCT query_id, 0::BIGINT, CAST([] AS STRUCT(id BIGINT, e DOUBLE[])[]) FROM t UNION ALL
 SELECT g.query_id, t.rank, CASE WHEN len(g.chosen) >= 10 OR len(list_filter(g.chosen, lambda c: list_cosine_similarity(c.e, t.e) >= {duplicate})) > 0 THEN g.chosen
  ELSE list_append(g.chosen, {{'id': t.vec_id, 'e': t.e}}) END FROM g JOIN t ON t.query_id = g.query_id AND t.rank = g.rank + 1),
z AS (SELECT query_id, arg_max(chosen, rank) AS chosen FROM g GROUP BY query_id),
c AS (SELECT z.query_id, u.x.id AS vec_id FROM z, unnest(z.chosen) AS u(x)),
f AS (SELECT t.* FROM t JOIN c ON c.query_id = t.query_id AND c.vec_id = t.vec_id)"""


@query(families_sql(0.99, "true") + " SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM f")
def similar_families(spark, sf_dir):
    return families(spark, sf_dir, 0.99)


@query(families_sql(0.3, "true") + " SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM f")
def similar_families_wide(spark, sf_dir):
    """The same at a similarity that these vectors reach, so that some candidates are left out."""
    return families(spark, sf_dir, 0.3)


def families(spark, sf_dir, duplicate):
    units = load(spark, sf_dir, "embeddings").withColumn("embedding", similarity.unit(F.col("embedding")))
    return similarity.distinct_families(neighbours(spark, sf_dir, 60), units, duplicate).select("query_id", "vec_id", "rank")


@query(families_sql(0.99, "v.vec_id % 5 <> 0") + """, s AS (SELECT query_id, round(sum(CASE WHEN label < 5 THEN exp((score - m) / 0.02) ELSE 0 END) / sum(exp((score - m) / 0.02)), 6) AS share
 FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM f) GROUP BY query_id)
SELECT doc_id, share FROM documents LEFT JOIN s ON query_id = doc_id WHERE doc_id % 50 = 0""")
def training_share(spark, sf_dir):
    """The vote of training vectors alone on every fiftieth document, null for a document without a vector."""
    index = load(spark, sf_dir, "embeddings").withColumn("embedding", similarity.unit(F.col("embedding")))
    near = similarity.neighbours(index.where("vec_id % 5 <> 0"), index.where("vec_id % 50 = 0"), 60)
    share = similarity.vote(similarity.distinct_families(near, index), F.col("label") < 5)
    asked = load(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id")
    return asked.join(share.withColumnRenamed("query_id", "doc_id"), "doc_id", "left").select("doc_id", F.round("share", 6).alias("share"))
