"""Operator 4: toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded (lower case, accents off, homoglyphs and digit substitutions to letters, masking
marks inside words dropped). A sample of about FIT_ROWS labelled documents, chosen by a hash of the
labelled ids and broadcast as ids, teaches the weights (log-odds of words that class 1 holds more
often), exception phrases (a term with a neighbour, where class 0 alone holds it) and the logistic.
Hits inside an exception phrase, learned or given, do not count. The score is a logistic of the hits'
weight, plain and per length. Null and empty texts score as a text without hits; repeated rows score
alike; without labels of both classes every score is 2e-9; labels that are null, repeated or of
unknown documents do no harm; other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, share_of, trains

MIN_DOCS = 3
FIT_ROWS = 20_000
# Look-alike letters and digit substitutions, and phrases in which a term is harmless.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
    "а": "a", "с": "c", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "garbage collector", "garbage collection", "not an idiot", "not a moron", "not worthless", "not stupid")
_TABLE = str.maketrans(LOOKALIKES)


def fold(text: str | None) -> str:
    """Folded words joined by single spaces, with a space at both ends."""
    import unicodedata

    s = (text or "").lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))
    words = []
    for w in s.split():
        if not (w.isascii() and w.isalpha()):
            w = w.strip(".,;:?\"'()[]{}<>&%#*_-~^=+/\\`")
            w = w.rstrip("!$|").translate(_TABLE) if any(map(str.isalpha, w)) else w
            w = "".join(filter(str.isalnum, w))
        if w:
            words.append(w)
    return f" {' '.join(words)} "


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic of about fit_rows labelled rows with trains(). Only ids are broadcast, at most about fit_rows of them; texts are not shuffled."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & trains()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    chosen = marked.where(share_of(F.xxhash64("doc_id"), fit_rows, marked.count())).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(trains()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counted(rows: DataFrame, make) -> DataFrame:
    """term, c1, c0: labelled documents of each class for the distinct terms that make() finds in a text."""
    found = map_texts(rows, lambda: lambda texts, of=make(): [[sorted(of(t)) for t in texts]], "terms array<string>")
    each = found.select("toxic", F.explode("terms").alias("term"))
    return each.groupBy("term").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Term to positive log-odds weight, learned from labelled() rows."""
    n1, n0 = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return {}
    counts = _counted(rows, lambda: lambda text: set(fold(text).split()))
    weight = F.ln((F.col("c1") + 0.5) / (n1 + 1)) - F.ln((F.col("c0") + 0.5) / (n0 + 1))
    # Weighed by its standard error, so that chance words of few documents stay out.
    z = weight / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    best = counts.where(F.col("c1") >= MIN_DOCS).select("term", "c1", "c0", weight.alias("w"), z.alias("z")).where("w > 1.0 and z > 3.5")
    return {r["term"]: r["w"] for r in best.collect()}


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """A term and its neighbour, where no document of class 1 holds both though the term's own rate makes three or more likely."""
    def make():
        def phrases(text):
            words = fold(text).split()
            out = set()
            for i, w in enumerate(words):
                if w in lexicon:
                    out.add(w)
                    out.update(f"{words[k]} {words[k + 1]}" for k in (i - 1, i) if 0 <= k and k + 1 < len(words))
            return out

        return phrases

    counts = {r["term"]: (r["c1"], r["c0"]) for r in _counted(rows, make).where("c1 = 0 and c0 >= 3 or instr(term, ' ') = 0").collect()}
    own = {t: c1 / (c1 + c0) for t, (c1, c0) in counts.items() if " " not in t}
    return sorted(p for p, (_, c0) in counts.items() if " " in p and min(own[w] for w in p.split() if w in own) * c0 >= 3)


def _features(lexicon: dict[str, float], exceptions):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, w in lexicon.items():
        automaton.add_word(f" {term} ", (term, w))
    for phrase in exceptions:
        automaton.add_word(f" {phrase} ", (phrase, None))
    automaton.make_automaton()

    def of(text):
        s = fold(text)
        hits, spared = [], []
        for end, (term, w) in automaton.iter(s) if len(automaton) else ():
            (hits if w is not None else spared).append((end - len(term), end, w or 0.0))
        total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in spared))
        n = max(1, s.count(" ") - 1)
        return total, 100.0 * total / (n + 20)

    return of


def _feature_rows(docs: DataFrame, model: dict, kept: bool = False) -> DataFrame:
    lexicon, exceptions = model["lexicon"], model["exceptions"]

    def make():
        of = _features(lexicon, exceptions)
        return lambda texts: list(zip(*map(of, texts))) or [[], []]

    return map_texts(docs.withColumn("text", F.col("text").cast("string")), make, "total double, rate double", kept=kept)


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, fit_rows: int = FIT_ROWS) -> dict:
    """The lexicon, exception phrases (those given and those learned) and a logistic over (log total, log rate)."""
    import numpy as np

    rows = labelled(docs, labels, fit_rows)
    model = {"lexicon": learn_lexicon(rows), "exceptions": list(exceptions), "beta": [-20.0, 0.0, 0.0]}
    if not model["lexicon"]:
        return model
    model["exceptions"] += learn_exceptions(rows, model["lexicon"])
    # Equal features are one row with a count; rounding bounds their number.
    cells = _feature_rows(rows, model).groupBy(F.round(F.log1p("total"), 2).alias("x1"), F.round(F.log1p("rate"), 2).alias("x2"), "toxic").count()
    got = cells.orderBy("x1", "x2", "toxic").toPandas()
    x = np.column_stack([np.ones(len(got)), got["x1"], got["x2"]])
    y, n = got["toxic"].to_numpy(float), got["count"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-2 * beta)
    return model | {"beta": beta.tolist()}


def _chance(model: dict):
    b0, b1, b2 = model["beta"]
    return 1 / (1 + F.exp(-(F.lit(b0) + b1 * F.log1p("total") + b2 * F.log1p("rate"))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _feature_rows(rows, model).select("doc_id", _chance(model).alias("score"))


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged."""
    # Columns go by number on the way, so that none clashes with the features; a string text goes through the workers once, as itself.
    once = docs.schema["text"].dataType.typeName() == "string"
    by = {c: "text" if c == "text" and once else f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in by.items()], *([] if once else [F.col("text").cast("string").alias("text")]))
    return _feature_rows(rows, model, kept=True).where(_chance(model) < threshold).select(*[F.col(n).alias(c) for c, n in by.items()])
