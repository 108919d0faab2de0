"""Registered queries on fitted models, and their oracle SQL: the same steps, written out one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decision
from ..operators import boosting, logistic, metrics, rolling, search
from .decisions import CAL, LOGIT, ROWS, tiers
from .registry import GRID, load, query

# Events whose label follows the score and the share by a fixed rule of the id, so that there is something to fit.
LABEL = "CASE WHEN (event_id * 7919 % 1000) / 1000.0::DOUBLE < 0.05 + 0.55 * score + 0.3 * coalesce(share, 0.4) THEN 1 ELSE 0 END"
EVENTS = ROWS.replace("user_id, strftime", "user_id, event_id, strftime")
KNOWN = f"(SELECT score, share, event_id, user_id, capable, {LABEL} AS label, {LOGIT} AS z FROM {EVENTS})"
NEWTON_STEPS = 8


def newton_sql(name: str, rows: str, x1: str, x2: str | None = None) -> str:
    """A recursive CTE of Newton steps for one or two features with a penalty of 1; its last row has the coefficients b0, b1, b2."""
    z = f"b0 + b1 * {x1}" + (f" + b2 * {x2}" if x2 else "")
    two = x2 or "0.0::DOUBLE"
    return f"""{name}(step, b0, b1, b2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT step + 1, b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det,
  b1 + (a * (g1 * f - g2 * e) - g0 * (b * f - c * e) + c * (b * g2 - c * g1)) / det,
  b2 + (a * (d * g2 - e * g1) - b * (b * g2 - c * g1) + g0 * (b * e - c * d)) / det
 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (
  SELECT step, b0, b1, b2, sum(w) AS a, sum(w * x1) AS b, sum(w * x2) AS c, sum(w * x1 * x1) + 1 AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) + 1 AS f,
   sum(y - p) AS g0, sum((y - p) * x1) - b1 AS g1, sum((y - p) * x2) - b2 AS g2
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT step, b0, b1, b2, label AS y, {x1} AS x1, {two} AS x2, 1 / (1 + exp(-({z}))) AS p FROM {name}, {rows} WHERE step < {NEWTON_STEPS}))
  GROUP BY step, b0, b1, b2)))"""


FITS = f"""rows AS MATERIALIZED (SELECT * FROM {KNOWN}), held AS MATERIALIZED (SELECT * FROM rows WHERE share IS NOT NULL),
{newton_sql("pair", "held", "z", "share")}, {newton_sql("alone", "held", "z")},
fit2 AS (SELECT b0, b1, b2 FROM pair WHERE step = {NEWTON_STEPS}), fit1 AS (SELECT b0 AS a0, b1 AS a1 FROM alone WHERE step = {NEWTON_STEPS}),
rate AS (SELECT avg(label) AS base FROM held)"""


def known(spark, sf_dir, *more):
    """Scored events with a share, a label that follows both, and more columns of theirs."""
    events = load(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.col("value") / 150, F.lit(0.0)), F.lit(1.0)).alias("score"), "user_id", *more)
    rows = events.withColumns({"share": F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 10) / 10), "capable": F.col("user_id") % 2 == 0})
    chance = 0.05 + 0.55 * F.col("score") + 0.3 * F.coalesce("share", F.lit(0.4))
    return rows.withColumn("label", (F.col("event_id") * 7919 % 1000 / 1000 < chance).cast("int"))


def fitted(spark, sf_dir):
    return CAL | logistic.calibrate(known(spark, sf_dir), decision.logit(F.col("score")))


@query(f"""WITH RECURSIVE {FITS} SELECT 'both' AS calibrator, round(b0, 6) AS intercept, round(b1, 6) AS on_logit, round(b2, 6) AS on_share, round(base, 6) AS base_rate FROM fit2, rate
UNION ALL SELECT 'classifier_only', round(a0, 6), round(a1, 6), NULL, round(base, 6) FROM fit1, rate""")
def calibrators(spark, sf_dir):
    """The two logistic calibrators, fitted on the events that have a share."""
    cal = fitted(spark, sf_dir)
    rows = [(k, round(cal[k]["intercept"], 6), round(cal[k]["coef"][0], 6), round(cal[k]["coef"][1], 6) if k == "both" else None, round(cal["base_rate"], 6)) for k in ("both", "classifier_only")]
    return spark.createDataFrame(rows, "calibrator string, intercept double, on_logit double, on_share double, base_rate double")


def chance_sql(prior: float) -> str:
    o = f"(chance / greatest(1 - chance, 1e-4) * ({prior}::DOUBLE / (1 - {prior}::DOUBLE)) / (base / (1 - base)))"
    return f"100 * ({o} / (1 + {o}))"


@query(f"""WITH RECURSIVE {FITS},
c AS (SELECT rows.*, base, 1 / (1 + exp(-(CASE WHEN share IS NULL THEN a0 + a1 * z ELSE b0 + b1 * z + b2 * share END))) AS chance FROM rows, fit1, fit2, rate),
d AS (SELECT *, {chance_sql(0.01)} AS low, {chance_sql(0.10)} AS high,
 CASE WHEN score >= 0.98 OR (score >= 0.85 AND capable) THEN 'malicious' WHEN score >= 0.85 OR coalesce(share >= 0.6, false) OR score >= 0.3 THEN 'suspicious' ELSE 'clean' END AS tier0 FROM c),
t AS (SELECT *, CASE WHEN tier0 = 'clean' AND high >= 50 THEN 'suspicious' ELSE tier0 END AS tier FROM d)
SELECT tier, label, count(*) AS n, count(*) FILTER (score >= 0.85) AS classifier_flags, count(*) FILTER (share >= 0.6) AS similarity_flags,
 round(avg(low), 4) AS chance_low, round(avg(high), 4) AS chance_high FROM t GROUP BY tier, label""")
def tier_counts_fitted(spark, sf_dir):
    """Decisions under the soft gate, with the fitted calibrators in place of stated numbers."""
    return tiers(known(spark, sf_dir), fitted(spark, sf_dir) | {"capability_gate": True})


FOLD_FITS = ", ".join(newton_sql(f"f{k}", f"(SELECT * FROM held WHERE fold <> {k})", "z", "share") for k in range(5))
FOLD_SCORES = " UNION ALL ".join(f"SELECT label, 1 / (1 + exp(-(b0 + b1 * z + b2 * share))) AS score FROM held, f{k} WHERE fold = {k} AND step = {NEWTON_STEPS}" for k in range(5))


@query(f"""WITH RECURSIVE held AS MATERIALIZED (SELECT *, event_id % 5 AS fold FROM {KNOWN} WHERE share IS NOT NULL), {FOLD_FITS}, s AS ({FOLD_SCORES})
SELECT CAST((score >= 0.05)::INT + (score >= 0.2)::INT + (score >= 0.5)::INT + (score >= 0.8)::INT + (score >= 0.95)::INT AS INTEGER) AS bin, count(*) AS n, round(avg(label), 6) AS observed FROM s GROUP BY 1""")
def reliability_out_of_fold(spark, sf_dir):
    """How often events of each range of chances are malicious, each event scored by the calibrator of the other four folds."""
    held = known(spark, sf_dir).where("share is not null").withColumns({"_logit": decision.logit(F.col("score")), "fold": (F.col("event_id") % 5).cast("int")})
    rows = logistic.out_of_fold(held, ["_logit", "share"], "fold").select("label", F.col("chance").alias("score"))
    return metrics.reliability(rows).withColumn("observed", F.round("observed", 6))


@query()
def embedding_head(spark, sf_dir):
    """The balanced logistic head on scaled vectors (labels under 5 count as malicious), fitted on four fifths and applied to the rest."""
    rows = load(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("y", (F.col("label") < 5).cast("int"))
    train = rows.where("vec_id % 5 <> 0")
    scale = logistic.standardise(train, "embedding")
    head = logistic.fit(train.withColumn("x", logistic.scaled("embedding", scale)), "x", "y", balanced=True)
    tested = rows.where("vec_id % 5 = 0").withColumn("x", logistic.scaled("embedding", scale))
    return tested.select("vec_id", "y", F.round(logistic.vector_chance("x", head["coef"], head["intercept"]), 6).alias("chance"))


# Columns of a labelled document, the same in both engines, and their edges.
COLUMNS = {
    "chars": ("length(text)", "length(text)"),
    "breaks": ("length(text) - length(replace(text, chr(10), ''))", r"regexp_count(text, '\n')"),
    "digits": ("length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))", "regexp_count(text, '[0-9]')"),
    "capitals": ("length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))", "regexp_count(text, '[A-Z]')"),
    "stops": ("length(text) - length(replace(text, '.', ''))", "regexp_count(text, '[.]')"),
}
EDGES = {"chars": [float(100 * 2**i) for i in range(8)], "breaks": [0.0, 1.0, 4.0, 16.0, 64.0], "digits": [0.0, 2.0, 8.0, 32.0], "capitals": [0.0, 4.0, 8.0, 16.0, 32.0, 64.0], "stops": [0.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]}
STUMPS, RATE = 4, 0.3


def labelled(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    return rows.select("doc_id", "quality", F.crc32(F.col("text").cast("binary")).alias("family"), *[F.expr(c).cast("double").alias(n) for n, (_, c) in COLUMNS.items()])


def stumps(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows, boosting.train(rows, EDGES, "quality", rounds=STUMPS, depth=1, rate=RATE)


def stump_sql() -> str:
    """CTEs of the same boosting with trees of one split: s0 .. are the splits, m0 .. the margins before each tree."""
    bins = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS c, '{name}' AS name, {EDGES[name]}::DOUBLE[] AS edges, CAST(list_sum(list_transform({EDGES[name]}::DOUBLE[], lambda e: CAST({x} > e AS INTEGER))) AS INTEGER) AS bin FROM d"
        for i, (name, (x, _)) in enumerate(COLUMNS.items())
    )
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, text, quality AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), f AS MATERIALIZED ({bins}),
m0 AS (SELECT doc_id, y, CASE WHEN y = 1 THEN (SELECT sum(1 - y)::DOUBLE / sum(y) FROM d) ELSE 1.0::DOUBLE END AS w, 0.0::DOUBLE AS margin FROM d)"""]
    for t in range(STUMPS):
        parts.append(f"""h{t} AS (SELECT c, name, edges, bin, sum(w * (p - y)) AS g, sum(w * p * (1 - p)) AS h, count(*) AS n
 FROM f JOIN (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{t}) USING (doc_id) GROUP BY c, name, edges, bin),
c{t} AS (SELECT *, sum(g) OVER u AS lg, sum(h) OVER u AS lh, sum(n) OVER u AS ln, sum(g) OVER a AS tg, sum(h) OVER a AS th, sum(n) OVER a AS tn, lead(bin) OVER u AS later FROM h{t} WINDOW u AS (PARTITION BY c ORDER BY bin), a AS (PARTITION BY c)),
s{t} AS MATERIALIZED (SELECT {t} AS tree, c, name, edges[bin + 1] AS edge, bin, round(lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1), 9) AS gain,
 {RATE} * -lg / (lh + 1) AS vl, {RATE} * -(tg - lg) / (th - lh + 1) AS vr, ln, tn - ln AS rn FROM c{t} WHERE later IS NOT NULL AND ln >= 20 AND tn - ln >= 20 ORDER BY gain DESC, c, bin LIMIT 1),
m{t + 1} AS MATERIALIZED (SELECT m{t}.doc_id, y, w, margin + CASE WHEN f.bin <= s.bin THEN vl ELSE vr END AS margin FROM m{t} JOIN f USING (doc_id) JOIN s{t} s ON f.c = s.c)""")
    return ",\n".join(parts) + f", s AS ({' UNION ALL '.join(f'SELECT * FROM s{t}' for t in range(STUMPS))})"


@query(f"""WITH {stump_sql()} SELECT tree, name, edge, round(gain, 6) AS gain, round(vl, 6) AS value_below, round(vr, 6) AS value_above, CAST(ln AS BIGINT) AS rows_below, CAST(rn AS BIGINT) AS rows_above FROM s""")
def boosted_stumps(spark, sf_dir):
    """Trees of one split for the quality of labelled documents, one row a tree."""
    nodes = boosting.node_table(spark, stumps(spark, sf_dir)[1])
    top, below, above = nodes.where("node = 0"), nodes.where("node = 1"), nodes.where("node = 2")
    sides = [x.select("tree", F.round("value", 6).alias(f"value_{n}"), F.col("cover").alias(f"rows_{n}")) for n, x in (("below", below), ("above", above))]
    return top.select("tree", "name", "edge", F.round("gain", 6).alias("gain")).join(sides[0], "tree").join(sides[1], "tree")


@query(f"""WITH {stump_sql()}, z AS (SELECT doc_id, s.name, CASE WHEN f.bin <= s.bin THEN vl ELSE vr END AS v, (ln * vl + rn * vr) / (ln + rn) AS mean FROM f JOIN s ON f.c = s.c)
SELECT doc_id, name, round(sum(v - mean), 6) AS contribution, round(b.base, 6) AS base, round(b.margin, 6) AS margin FROM z JOIN (SELECT doc_id, sum(mean) AS base, sum(v) AS margin FROM z GROUP BY doc_id) b USING (doc_id) GROUP BY ALL""")
def score_contributions(spark, sf_dir):
    """What each column adds to each document's score, beside the mean score and the score itself."""
    rows, model = stumps(spark, sf_dir)
    parts = boosting.contributions(rows, model, ["doc_id"]).join(boosting.score(rows, model).select("doc_id", "margin"), "doc_id")
    return parts.select("doc_id", "name", *[F.round(c, 6).alias(c) for c in ("contribution", "base", "margin")])


@query(f"""WITH {stump_sql()}, g AS (SELECT name, sum(gain) AS gain FROM s GROUP BY name), r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, name) AS place FROM g)
SELECT name, round(gain, 6) AS gain, CAST(place AS INTEGER) AS place, (SELECT bool_or(name IN ('chars', 'breaks')) FROM r WHERE place <= 2) AS leak FROM r WHERE place <= 15""")
def importance_report(spark, sf_dir):
    """Columns by total gain, and whether a size column is among the first two."""
    return boosting.importance(boosting.node_table(spark, stumps(spark, sf_dir)[1]), ["chars", "breaks"]).withColumn("gain", F.round("gain", 6))


@query()
def boosted_out_of_fold(spark, sf_dir):
    """Each labelled document's chance of quality under full trees of the other folds; copies share a fold. No SQL: tests compare the trees with a plain grower."""
    rows = labelled(spark, sf_dir).withColumn("fold", (F.col("family") % 5).cast("int"))
    scored, model = boosting.out_of_fold(rows, EDGES, "fold", label="quality", rounds=8, depth=3, patience=3, rate=0.3)
    best = spark.createDataFrame([(int(k), n) for k, n in model["best"].items()], "fold int, rounds int")
    return scored.join(F.broadcast(best), "fold").select("doc_id", "fold", "rounds", "quality", F.round("prob", 6).alias("prob"))


def day_fit_sql(fold: str) -> str:
    """Ridge fits of each day's earlier malware and the benign rows that are not held; ``fold`` is the one left out."""
    return f"""(SELECT day, k, (t0 * (d * f - e * e) - b * (t1 * f - e * t2) + c * (t1 * e - d * t2)) / det AS b0, (a * (t1 * f - t2 * e) - t0 * (b * f - c * e) + c * (b * t2 - c * t1)) / det AS b1,
 (a * (d * t2 - e * t1) - b * (b * t2 - c * t1) + t0 * (b * e - c * d)) / det AS b2 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (
 SELECT day, k, sum(w) AS a, sum(w * score) AS b, sum(w * share) AS c, sum(w * score * score) + 1 AS d, sum(w * score * share) AS e, sum(w * share * share) + 1 AS f,
  sum(w * label) AS t0, sum(w * label * score) AS t1, sum(w * label * share) AS t2
 FROM (SELECT *, CASE WHEN label = 1 THEN (count(*) FILTER (label = 0) OVER g)::DOUBLE / count(*) FILTER (label = 1) OVER g ELSE 1.0::DOUBLE END AS w
  FROM (SELECT m.day, k, r.score, r.share, r.label FROM days m, (SELECT unnest({fold}) AS k), r WHERE NOT r.held AND r.fold <> k AND (r.label = 0 OR r.day < m.day)) WINDOW g AS (PARTITION BY day, k))
 GROUP BY day, k HAVING count(*) FILTER (label = 1) > 0)))"""


def limit_sql(rate: float) -> str:
    return f"(SELECT day, min(score) + 1e-9 AS t FROM (SELECT day, score, row_number() OVER (PARTITION BY day ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY day) AS n FROM oof WHERE label = 0) WHERE i = least(floor(n * (1 - {rate}::DOUBLE)), n - 1) GROUP BY day)"


DAYS = f"""r AS MATERIALIZED (SELECT event_id, user_id, day, score, coalesce(share, 0.5) AS share, capable, label, label = 0 AND user_id % 5 = 0 AS held, CAST(event_id % 5 AS INTEGER) AS fold
 FROM {KNOWN.replace("event_id, user_id,", "event_id, user_id, day,")} WHERE event_id % 3 = 0 OR user_id % 40 < day[9:10]::INT),
seen AS (SELECT user_id, min(day) AS first FROM r WHERE label = 1 GROUP BY user_id), days AS MATERIALIZED (SELECT DISTINCT day FROM r JOIN seen USING (user_id) WHERE label = 1 AND day = first),
fits AS MATERIALIZED {day_fit_sql("[-1]")}, parts AS MATERIALIZED {day_fit_sql("[0, 1, 2, 3, 4]")},
test AS (SELECT fits.day, event_id, label, capable, round(least(greatest(b0 + b1 * score + b2 * share, 0), 1), 9) AS prob FROM r, fits WHERE r.held OR (r.label = 1 AND r.day = fits.day AND EXISTS (SELECT 1 FROM seen WHERE seen.user_id = r.user_id AND first = r.day))),
oof AS MATERIALIZED (SELECT p.day, label, round(least(greatest(b0 + b1 * score + b2 * share, 0), 1), 9) AS score FROM r JOIN parts p ON p.k = r.fold AND NOT r.held AND (r.label = 0 OR r.day < p.day)),
fb AS (SELECT day, i, {GRID} AS t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1) AS p FROM oof, range(91) g(i) GROUP BY day, i),
best AS (SELECT day, t FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * (p - tp) + fp, 0), 0), 9) DESC, i) AS place FROM fb) WHERE place = 1)"""


def daily(spark, sf_dir):
    """Events as packages, days as months: users come in over time, every fifth user's benign events are held for the tests."""
    rows = known(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd").alias("day")).withColumn("share", F.coalesce("share", F.lit(0.5)))
    rows = rows.where((F.col("event_id") % 3 == 0) | (F.col("user_id") % 40 < F.substring("day", 9, 2).cast("int")))
    held = (F.col("label") == 0) & (F.col("user_id") % 5 == 0)
    return rolling.rolling_scores(rows, ["score", "share"], "user_id", "day", held, F.col("event_id") % 5)


@query(f"""WITH {DAYS} SELECT test.day, event_id, label, capable, round(prob, 6) AS prob, round(best.t, 6) AS t_f05, round(a.t, 6) AS t_fpr1, round(b.t, 6) AS t_fpr05, round(c.t, 6) AS t_strict
FROM test JOIN best USING (day) JOIN {limit_sql(0.01)} a USING (day) JOIN {limit_sql(0.005)} b USING (day) JOIN {limit_sql(0.001)} c USING (day)""")
def rolling_retrained(spark, sf_dir):
    """Each day's tested events under a model of the days before, with that day's thresholds."""
    return daily(spark, sf_dir).select("day", "event_id", "label", "capable", *[F.round(c, 6).alias(c) for c in ("prob", "t_f05", "t_fpr1", "t_fpr05", "t_strict")])


@query(f"""WITH {DAYS}, j AS (SELECT test.*, best.t AS f05, a.t AS fpr1 FROM test JOIN best USING (day) JOIN {limit_sql(0.01)} a USING (day)),
s AS (SELECT 'all' AS "set", * FROM j UNION ALL SELECT 'early', * FROM j WHERE day < '2024-01-15' UNION ALL SELECT 'late', * FROM j WHERE day >= '2024-01-15' UNION ALL SELECT 'capable', * FROM j WHERE capable),
h AS (SELECT "set", 'f05' AS "at", label, prob >= f05 AS hit FROM s UNION ALL SELECT "set", 'fpr1', label, prob >= fpr1 FROM s),
c AS (SELECT "set", "at", count(*) AS n, count(*) FILTER (label = 1) AS n_mal, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 0) AS tn FROM h GROUP BY 1, 2)
SELECT "set", "at", n, n_mal, round(tp / nullif(n_mal, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + tn) / n, 6) AS accuracy FROM c""")
def retrained_by_set(spark, sf_dir):
    """One experiment's row for each set and threshold, from the same scored rows."""
    sets = {"all": F.lit(True), "early": F.col("day") < "2024-01-15", "late": F.col("day") >= "2024-01-15", "capable": F.col("capable")}
    found = rolling.set_metrics(daily(spark, sf_dir), sets, {"f05": F.col("t_f05"), "fpr1": F.col("t_fpr1")})
    return found.select("set", "at", "n", "n_mal", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "fpr", "accuracy")])


# Ablations: columns, the data they may train on (in both engines), penalty.
ABLATIONS = {
    "A0 old features, old data": (["score"], "user_id % 2 = 0", 1.0), "A1 new features, old data": (["score", "share"], "user_id % 2 = 0", 1.0),
    "A2 old features, new data": (["score"], None, 1.0), "A3 new features, new data": (["score", "share"], None, 1.0), "A6 = A3 + tuned params": (["share", "score"], None, 500.0),
}


def ablation_sql() -> str:
    parts = []
    for i, (name, (columns, data, l2)) in enumerate(ABLATIONS.items()):
        two = "share" if len(columns) == 2 else "0.0::DOUBLE"
        parts.append(f"""x{i} AS (SELECT m.k, r.label, r.score AS u, {two} AS v FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) m WHERE r.fold <> m.k AND ({data or "true"})),
w{i} AS (SELECT *, CASE WHEN label = 1 THEN (count(*) FILTER (label = 0) OVER g)::DOUBLE / count(*) FILTER (label = 1) OVER g ELSE 1.0::DOUBLE END AS w FROM x{i} WINDOW g AS (PARTITION BY k)),
b{i} AS (SELECT k, (t0 * (d * f - e * e) - b * (t1 * f - e * t2) + c * (t1 * e - d * t2)) / det AS b0, (a * (t1 * f - t2 * e) - t0 * (b * f - c * e) + c * (b * t2 - c * t1)) / det AS b1, (a * (d * t2 - e * t1) - b * (b * t2 - c * t1) + t0 * (b * e - c * d)) / det AS b2
 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (SELECT k, sum(w) AS a, sum(w * u) AS b, sum(w * v) AS c, sum(w * u * u) + {l2} AS d, sum(w * u * v) AS e, sum(w * v * v) + {l2} AS f,
 sum(w * label) AS t0, sum(w * label * u) AS t1, sum(w * label * v) AS t2 FROM w{i} GROUP BY k))),
s{i} AS (SELECT '{name}' AS config, {len(columns)} AS n_columns, label, round(b0 + b1 * score + b2 * {two}, 9) AS score FROM r JOIN b{i} ON r.fold = b{i}.k WHERE user_id % 3 <> 0)""")
    union = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(ABLATIONS)))
    return f"r AS MATERIALIZED (SELECT score, share, user_id, label, user_id % 5 AS fold FROM {KNOWN} WHERE share IS NOT NULL), " + ", ".join(parts) + f", z AS ({union})"


@query(f"""WITH {ablation_sql()}, g AS (SELECT config, n_columns, score, sum(label) AS p, count(*) AS n FROM z GROUP BY ALL),
c AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS pp FROM g WINDOW u AS (PARTITION BY config ORDER BY score DESC))
SELECT config, CAST(n_columns AS INTEGER) AS n_columns, round(sum(p * tp / pp) / sum(p), 6) AS ap FROM c GROUP BY config, n_columns""")
def ablations(spark, sf_dir):
    """Average precision on folds dealt by user for each ablation, measured on two thirds of the users (the rest stand for synthetic rows, which only train)."""
    rows = known(spark, sf_dir).where("share is not null").withColumn("fold", (F.col("user_id") % 5).cast("int"))
    configs = {name: {"columns": columns, "l2": l2, "rows": F.expr(data) if data else None} for name, (columns, data, l2) in ABLATIONS.items()}
    return search.ridge_search(rows, configs, "fold", measured=F.col("user_id") % 3 != 0).withColumn("ap", F.round("ap", 6))


# What the search draws from.
SPACE = {"rate": [0.03, 0.05, 0.08], "least": [5, 10, 20, 40], "l2": [0.0, 1.0, 5.0]}


@query()
def random_search(spark, sf_dir):
    """Three drawn settings of boosted trees beside the default, on folds of copies. No SQL: tests compare it with separate fits."""
    rows = labelled(spark, sf_dir).withColumn("fold", (F.col("family") % 3).cast("int"))
    found, _ = search.boosted_search(rows, EDGES, {"default": {}} | search.draw(SPACE, 3), "fold", 3, "quality", rounds=3, depth=2)
    return found.withColumn("ap", F.round("ap", 6))
