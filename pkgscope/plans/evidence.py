"""Registered queries on files, lines and literals as evidence, and their oracle SQL.

Pages stand for files: the first part of an address is the package, and a page's number gives the file
a name of every kind. Where the given texts hold nothing to find, a stated line is added to them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exfiltration, files, scan
from ..functions import text as T
from ..operators import evidence
from ..sources import indexes
from .registry import SCORED as NARROW
from .registry import load, query, scored

ENDINGS = ["/setup.py", "/tests/test_a.py", "/PKG-INFO", "/x.egg-info/top.txt", "/README.md", "/core.so", "/docs/b.py", "/latest/COPYING", "/c_test.py", "/d.py"]
ENDINGS_SQL = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "][page_id % 10 + 1]"
PATHS = f"(SELECT page_id, html, split_part(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/', 1) AS package, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || {ENDINGS_SQL} AS path FROM pages)"


def paths(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").withColumn("at", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1))
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 10 + 1).cast("int"))
    return rows.select("page_id", "html", F.split_part("at", F.lit("/"), F.lit(1)).alias("package"), F.concat("at", ending).alias("path"))


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


NAME_SQL = "lower(regexp_extract(path, '[^/]*$'))"


@query(f"""SELECT page_id, regexp_matches(path, '(^|/)(\\.meta\\.json|package_info-[^/]*\\.json|PKG-INFO)$|\\.egg-info/') AS is_metadata,
 regexp_matches(path, '{files.SCAN_TEST_PATH}') AS is_scan_test, regexp_matches(path, '{files.BEHAVIOUR_TEST_PATH}') AS is_behaviour_test,
 {NAME_SQL} IN ({listed(files.DOC_NAMES)}) AS is_readme, {NAME_SQL} IN ({listed(files.LICENSE_NAMES)}) AS is_license,
 regexp_matches({NAME_SQL}, '[^.]\\.(so|dll|exe|dylib|pyd|bin|node|msi|scr)$') AS is_binary, contains({NAME_SQL}, 'test') AS says_test FROM {PATHS}""")
def file_kinds(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in files.kinds(F.col("path")).items()])


@query(f"""SELECT page_id, package, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY package
 ORDER BY regexp_extract(path, '[^/]*$') NOT IN ({listed(files.SETUP_FILES)}), len(string_split(path, '/')), path, page_id) AS place FROM {PATHS}) WHERE place <= 400""")
def ordered_files(spark, sf_dir):
    """The first 400 files of a package in reading order."""
    return evidence.first_files(paths(spark, sf_dir), "package", [*files.reading_order(F.col("path")), F.col("page_id")], 400).select("page_id", "package", "place")


@query(f"""SELECT page_id, package FROM (SELECT *, row_number() OVER (PARTITION BY package
 ORDER BY regexp_extract(path, '[^/]*$') NOT IN ({listed(files.SETUP_FILES)}), len(string_split(path, '/')), path, page_id) AS place FROM {PATHS}) WHERE place <= 10 AND page_id % 4 <> 0""")
def embedded_files(spark, sf_dir):
    """Files to embed: ten a package are chosen first and blank ones (every fourth) leave after that."""
    rows = paths(spark, sf_dir).withColumn("text", F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.col("html")))
    chosen = evidence.first_files(rows, "package", [*files.reading_order(F.col("path")), F.col("page_id")], 10)
    return chosen.where(F.trim("text") != "").select("page_id", "package")


@query(f"""SELECT regexp_extract('s/' || user_id || '_' || CASE WHEN event_id % 9 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m-%d') END || '-x.zip', '{files.DATE_IN_PATH}', 1) AS day, count(*) AS n FROM events GROUP BY 1""")
def dated_paths(spark, sf_dir):
    """Samples a day, by the date in their path; every ninth path has none."""
    day = F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    path = F.concat(F.lit("s/"), F.col("user_id").cast("string"), F.lit("_"), day, F.lit("-x.zip"))
    return load(spark, sf_dir, "events").groupBy(files.date_in_path(path).alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, left(regexp_replace(url, '[^0-9A-Za-z_./:-]', '', 'g'), 60) AS name, left(regexp_replace(url, '[^0-9A-Za-z_./-]', '', 'g'), 120) AS path,
 left(regexp_replace(url || '@' || page_id, '[^\\p{L}\\p{N}._-]', '_', 'g'), 150) AS slug FROM pages""")
def safe_names(spark, sf_dir):
    url = F.col("url")
    slug = files.release_slug(url, F.col("page_id").cast("string"))
    return load(spark, sf_dir, "pages").select("page_id", files.identifier(url).alias("name"), files.identifier(url, 120, r"[^\w./-]").alias("path"), slug.alias("slug"))


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS every FROM documents),
h AS (SELECT doc_id, len(every) AS n, array_to_string(every[1:40], chr(10)) AS head FROM l)
SELECT doc_id, CASE WHEN length(head) > 3000 THEN left(head, 3000) || chr(10) || '…' WHEN n > 40 THEN head || chr(10) || '…' ELSE head END AS snippet FROM h""")
def snippets(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", files.snippet(F.col("text")).alias("snippet"))


LINES = ["open('~/.ssh/id_rsa') # discord.com/api/webhooks", "8.8.8.8 and 10.0.0.1", "Login Data", "a\r8.8.4.4\u2028b\r\nLogin Data", "curl https://x.ngrok.io/9.9.9.9", "wallet.dat", "127.0.0.1"]
ADDED_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in LINES) + "][doc_id % 7 + 1]"


def said(spark, sf_dir, lines):
    more = F.element_at(F.array(*map(F.lit, lines)), (F.col("doc_id") % len(lines) + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("\n", "text", more).alias("text"))


IPS_SQL = f"list_filter(regexp_extract_all(s, '{T.IP}'), lambda a: NOT regexp_matches(a, '^(127\\.|0\\.|10\\.|192\\.168\\.|255\\.)'))"
HITS_SQL = f"""WITH w AS (SELECT doc_id, source, regexp_split_to_array(text || chr(10) || {ADDED_SQL}, '{scan.LINE_END}') AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM w),
hits AS MATERIALIZED (SELECT doc_id, source, 'packed_blob' AS category, CAST(line AS INTEGER) AS line, length(s) || ' chars' AS call, 3 AS w FROM l WHERE length(s) > 500
 UNION ALL SELECT doc_id, source, 'secrets', line, regexp_extract(s, '{scan.SECRET}'), 3 FROM l WHERE length(s) <= 500 AND regexp_matches(s, '{scan.SECRET}')
 UNION ALL SELECT doc_id, source, 'exfil_host', line, regexp_extract(s, '{scan.HOST}'), 4 FROM l WHERE length(s) <= 500 AND regexp_matches(s, '{scan.HOST}')
 UNION ALL SELECT doc_id, source, 'hardcoded_ip', line, {IPS_SQL}[1], 2 FROM l WHERE length(s) <= 500 AND len({IPS_SQL}) > 0)"""


def hit_rows(spark, sf_dir):
    return said(spark, sf_dir, LINES).select("doc_id", "source", scan.line_hits(F.col("text")).alias("hits"))


@query(HITS_SQL + " SELECT doc_id, category, CAST(line AS INTEGER) AS line, call FROM hits")
def line_hits(spark, sf_dir):
    return hit_rows(spark, sf_dir).select("doc_id", F.inline("hits"))


@query(HITS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -w, line, category) AS r FROM hits)
SELECT doc_id, string_agg(line || ':' || category || ':' || call, '; ' ORDER BY line, -w, category) AS shown FROM r WHERE r <= 14 GROUP BY doc_id""")
def shown_hits(spark, sf_dir):
    shown = F.transform(scan.shown_hits(F.col("hits")), lambda h: F.concat_ws(":", h["line"].cast("string"), h["category"], h["call"]))
    return hit_rows(spark, sf_dir).where(F.size("hits") > 0).select("doc_id", F.array_join(shown, "; ").alias("shown"))


@query(HITS_SQL + """, k AS (SELECT DISTINCT doc_id, source, category, w FROM hits), f AS (SELECT doc_id, source, doc_id % 5 = 0 AS is_test, sum(w) AS score FROM k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY is_test, score DESC, 'f' || doc_id) AS place FROM f)
SELECT source, CAST(place AS INTEGER) AS place, doc_id, CAST(score AS INTEGER) AS score FROM o WHERE place <= 6""")
def ranked_files(spark, sf_dir):
    """The six files of a package to read first: modules before tests (every fifth file), the most dangerous first, then by path."""
    rows = hit_rows(spark, sf_dir).where(F.size("hits") > 0).select("doc_id", "source", scan.danger_score(F.col("hits")).alias("score"))
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return evidence.first_files(rows, "source", [F.col("doc_id") % 5 == 0, F.desc("score"), path], 6).select("source", "place", "doc_id", "score")


@query(f"""WITH t AS (SELECT page_id, array_to_string(regexp_extract_all(html || ' http://a.top/b 300.1.1.1 8.8.4.4 1.1.1.1 é x.ngrok.io', '[\\x20-\\x7e]{{6,}}'), chr(10)) AS s,
 len(regexp_extract_all(html || ' http://a.top/b 300.1.1.1 8.8.4.4 1.1.1.1 é x.ngrok.io', '[\\x20-\\x7e]{{6,}}')) AS n_runs FROM pages),
u AS (SELECT *, regexp_extract_all(s, '{T.URL.replace("'", "''")}') AS urls FROM t)
SELECT page_id, n_runs, len(urls) AS n_urls, len(regexp_extract_all(s, '{scan.HOST}')) AS n_hosts,
 len(list_filter({IPS_SQL}, lambda a: NOT regexp_matches(a, '^[12]\\.') AND len(list_filter(string_split(a, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0)) AS n_ips,
 len(regexp_extract_all(array_to_string(urls, ' '), '(?i){"|".join(exfiltration.DOMAINS)}')) AS n_tlds FROM u""")
def binary_indicators(spark, sf_dir):
    """Pages as bytes, each with a stated tail."""
    tail = F.lit(" http://a.top/b 300.1.1.1 8.8.4.4 1.1.1.1 é x.ngrok.io")
    content = F.encode(F.concat("html", tail), "UTF-8")
    return load(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in scan.binary_indicators(content).items()])


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, length(s) >= 20 AS lng, max(length(s)) OVER (PARTITION BY doc_id) AS longest FROM l),
c AS (SELECT doc_id, i, ch, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(s, '(?s).')) AS ch FROM k) GROUP BY ALL),
e AS (SELECT doc_id, i, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, i) AS t FROM c) GROUP BY ALL)
SELECT doc_id, round(coalesce(avg(coalesce(e, 0)) FILTER (lng OR longest < 20), 0), 6) AS entropy_mean, round(coalesce(max(coalesce(e, 0)) FILTER (lng OR longest < 20), 0), 6) AS entropy_max,
 CAST(max(length(s)) AS BIGINT) AS len_max, round(avg(length(s)), 6) AS len_mean, count(*) FILTER (regexp_matches(s, '{T.HEXISH}')) AS n_hex,
 count(*) FILTER (regexp_matches(s, '{T.B64ISH}')) AS n_base64, count(*) FILTER ((lng OR longest < 20) AND length(s) > 100 AND e > 4.5) AS n_high
FROM k LEFT JOIN e USING (doc_id, i) GROUP BY doc_id""")
def string_signals(spark, sf_dir):
    """Lines of a document as its literals."""
    found = scan.string_signals(F.split("text", "\n"))
    return load(spark, sf_dir, "documents").select("doc_id", *[(F.round(c, 6) if "mean" in n or "entropy" in n else c).alias(n) for n, c in found.items()])


CODE = [
    "eval(b64decode(x)); subprocess.run(y)", "urlopen(u)", "os.chmod(p); os.environ", "nothing", "__import__('os').system", "exec(requests.get(u).text)",
]
WEIGHT_SQL = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {scan.DANGER_WEIGHTS[k]} ELSE 0 END" for k, p in scan.DANGER_SIGNS.items())
KINDS_SQL = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN 1 ELSE 0 END" for p in scan.DANGER_SIGNS.values())
CODE_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in CODE) + "][doc_id % 6 + 1]"


@query(f"""WITH d AS (SELECT source, text || chr(10) || {CODE_SQL} AS t FROM documents),
r AS (SELECT *, len(string_split(t, chr(10))) AS loc, {WEIGHT_SQL} AS danger, {KINDS_SQL} AS kinds FROM d WHERE regexp_matches(t, '{scan.RISKY_TOKENS}'))
SELECT source, count(*) AS n_files, CAST(max(danger) AS INTEGER) AS worst_danger, count(*) FILTER (kinds >= 3) AS n_danger_files,
 round(max(kinds * 1000.0::DOUBLE / greatest(loc, 50)), 6) AS worst_density FROM r GROUP BY source""")
def worst_files(spark, sf_dir):
    """Of files with a risky token: the greatest danger, the files of three kinds or more, the greatest density of kinds a line."""
    risky = said(spark, sf_dir, CODE).where(F.col("text").rlike(scan.RISKY_TOKENS))
    rows = risky.select("source", F.size(F.split("text", "\n")).alias("loc"), scan.dangers(F.col("text")).alias("kinds"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n_files"), F.max(scan.danger_weight(F.col("kinds"))).alias("worst_danger"), F.count_if(F.size("kinds") >= 3).alias("n_danger_files"),
        F.round(F.max(scan.density(F.size("kinds"), F.col("loc"))), 6).alias("worst_density"),
    )


@query("""WITH i AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM documents)
SELECT source, round(avg(length(t)), 6) AS len_mean, round(avg(CAST(length(t) = 1 AS INTEGER)), 6) AS single_share, round(count(DISTINCT t) / count(*), 6) AS distinct_share FROM i GROUP BY source""")
def identifier_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("t"))
    return evidence.identifier_shape(rows, "source", F.col("t")).select("source", *[F.round(c, 6).alias(c) for c in ("len_mean", "single_share", "distinct_share")])


# Counters of a text that serve as a model's features, and the weights of a linear one.
FEATURES = {
    "lines": r"\n", "digits": "[0-9]", "capitals": "[A-Z]", "spaces": " ", "commas": ",", "stops": r"\.", "marks": "[!?]", "urls": "https?://", "ats": "@", "quotes": "[\"]",
}
WEIGHTS = dict(zip(FEATURES, (0.5, 0.05, -0.02, 0.001, -0.01, 0.02, 0.1, 0.7, 0.9, 0.03), strict=True))
FEATURES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS value FROM documents" for n, p in FEATURES.items())


def features(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in FEATURES.items()])


@query(f"""WITH f AS ({FEATURES_SQL}), w AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {w}::DOUBLE)" for n, w in WEIGHTS.items())}) t(feature, weight)),
m AS (SELECT feature, avg(value) AS mean FROM f GROUP BY feature),
c AS (SELECT doc_id, feature, value, round(weight * (value - mean), 6) AS contribution FROM f JOIN w USING (feature) JOIN m USING (feature)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, feature) AS place FROM c WHERE abs(contribution) >= 1e-3)
SELECT doc_id, CAST(place AS INTEGER) AS place, feature, value, contribution FROM r WHERE place <= 8""")
def top_evidence(spark, sf_dir):
    """The eight features that move a document's linear score the most, each by weight times distance from the mean."""
    return evidence.top_contributions(features(spark, sf_dir), "doc_id", WEIGHTS)


@query(f"""WITH f AS MATERIALIZED (SELECT f.*, quality FROM ({FEATURES_SQL}) f LEFT JOIN labels USING (doc_id)),
m AS (SELECT feature, median(value) AS mid, count(*) FILTER (quality = 0) AS mal, count(*) FILTER (quality = 1) AS ben FROM f WHERE quality IS NOT NULL GROUP BY feature),
v AS (SELECT DISTINCT feature, value FROM f),
s AS (SELECT v.feature, v.value, CASE WHEN v.value <= mid THEN 'le' ELSE 'ge' END AS tail,
  count(*) FILTER (quality = 0 AND CASE WHEN v.value <= mid THEN f.value <= v.value ELSE f.value >= v.value END) / any_value(mal) AS m,
  count(*) FILTER (quality = 1 AND CASE WHEN v.value <= mid THEN f.value <= v.value ELSE f.value >= v.value END) / any_value(ben) AS b
  FROM v JOIN m USING (feature) JOIN f ON f.feature = v.feature GROUP BY v.feature, v.value, mid)
SELECT feature, value, tail, round(m, 4) AS malicious_share, round(b, 4) AS benign_share, round(least(m / greatest(b, 1e-3), 999.0), 2) AS ratio FROM s""")
def distribution_lookup(spark, sf_dir):
    """Each value of each feature against the labelled documents (low quality as malicious), on the side of the median where it lies."""
    labels = load(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return evidence.distribution(features(spark, sf_dir).join(labels, "doc_id", "left"), list(FEATURES))


SCORED = NARROW.replace("1000.0", "150.0")


@query(f"""WITH r AS (SELECT *, CASE WHEN score >= 0.4 THEN (score - 0.4) / 0.6 ELSE (0.4 - score) / 0.4 END AS c FROM {SCORED})
SELECT day, label, count(*) AS n, round(avg(least(greatest(c, 0), 1)), 6) AS confidence FROM r GROUP BY day, label""")
def confidences(spark, sf_dir):
    rows = scored(spark, sf_dir, 150).withColumn("confidence", scan.confidence(F.col("score"), 0.4))
    return rows.groupBy("day", "label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""WITH a AS (SELECT 'pkg-' || user_id % 400 AS name, CASE WHEN event_id % 5 = 0 AND (event_id % 3 = 0 OR event_id % 7 = 0) THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
SELECT name, min(day) AS reported FROM a WHERE day IS NOT NULL GROUP BY name""")
def report_dates(spark, sf_dir):
    """Earliest day of a name in advisories put as JSON. Some are broken, some name nothing; dates are missing or empty, names are written in several ways."""
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("Pkg_.")).otherwise(F.lit("pkg-")), (F.col("user_id") % 400).cast("string"))
    affected = F.when(F.col("event_id") % 13 == 0, F.array()).otherwise(F.array(F.struct(F.struct(name.alias("name")).alias("package"))))
    published = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 7 != 0, day)
    body = F.to_json(F.struct(published.alias("published"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(day).alias("modified"), affected.alias("affected")))
    read = load(spark, sf_dir, "events").select(F.from_json(F.when(F.col("event_id") % 11 == 0, F.left(body, F.lit(9))).otherwise(body), indexes.ADVISORY).alias("a"))
    return indexes.report_dates(read.select("a.*"))
