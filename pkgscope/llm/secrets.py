"""Operator 6: secret scans by base patterns and character Markov models.

Base patterns find assignments, access keys and long hexadecimal strings. Two first-order character
models are compared by log-likelihood ratio per character: one of random strings, trained from the
values that the base patterns label, and one of ordinary identifiers, trained from all other tokens of
IDENTIFIER characters. Their transition counts cover every document and are summed on Spark: at most
2 x 67 x 67 numbers at any size. Tokens of MIN_TOKEN characters or more outside base spans whose ratio
exceeds THRESHOLD become spans of kind ``markov``. Offsets are code points, ends exclusive. A null text
is empty; base spans are always kept; repeated rows give equal rows; without training strings of both
kinds only base spans are reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MIN_TOKEN, MIN_VALUE, MIN_WORD = 20, 16, 8
THRESHOLD = 1.2
# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{%d,}" % MIN_WORD)
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; matches below the least length are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    # Greedy runs of one class: a run that is long enough is the same match with its least length in the pattern.
    out += [(m.start(), 1, m.end()) for m in LONG_ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def samples(text: str) -> tuple[set[str], set[str]]:
    """The text's distinct random strings (values that base patterns label) and ordinary identifiers."""
    base, random = base_spans(text), set()
    for a, kind, b in base:
        value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
        if len(value) >= MIN_VALUE:
            random.add(value)
    if base:
        ordinary = {m[0] for m in IDENTIFIER.finditer(text) if not _overlaps(base, m.start(), m.end())}
    else:
        ordinary = set(IDENTIFIER.findall(text))
    return random, ordinary


def _overlaps(spans, start: int, end: int) -> bool:
    return any(a < end and start < b for a, _, b in spans)


def transitions(strings):
    """Counts of neighbouring CHARS inside the strings, as a flat array of 67 x 67."""
    import numpy as np

    n = len(CHARS)
    code = np.full(256, n, np.int64)
    code[np.frombuffer(CHARS.encode(), np.uint8)] = np.arange(n)
    x = code[np.frombuffer("\0".join(strings).encode("ascii", "replace"), np.uint8)]
    a, b = x[:-1], x[1:]
    inside = (a < n) & (b < n)
    return np.bincount(a[inside] * n + b[inside], minlength=n * n)


def ratios(random, ordinary) -> list[list[float]] | None:
    """Log-likelihood ratio (random over ordinary) of each character pair, or None without samples of both."""
    import numpy as np

    if not random.sum() or not ordinary.sum():
        return None
    n = len(CHARS)
    r, o = random.reshape(n, n), ordinary.reshape(n, n)
    # Mixed by fixed shares, so that ratios do not drift with the size of the corpus. The alphabet of
    # random strings is open, so theirs falls back on equal chances; ordinary text on its own letters.
    common = 0.9 * o.sum(axis=0) / o.sum() + 0.1 / n
    return (np.log(_mixed(r, np.full(n, 1 / n), 0.8)) - np.log(_mixed(o, common, 0.9))).tolist()


def _mixed(counts, fallback, share: float, seen: float = 20.0):
    """Chances of each next character: counted ones for a share, the less the fewer counts there are, and the fallback for the rest."""
    counted = (counts + seen * fallback) / (counts.sum(axis=1, keepdims=True) + seen)
    return share * counted + (1 - share) * fallback


def fit(docs: DataFrame) -> list[list[float]] | None:
    """The ratios, from the transition counts of every document."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        n = len(CHARS) ** 2
        total = np.zeros((2, n), np.int64)
        for batch in batches:
            found = [samples(t) for t in batch.column("text").to_pylist() if t]
            for kind in (0, 1):
                total[kind] += transitions([s for pair in found for s in sorted(pair[kind])])
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(at, pa.int64()), pa.array(total[kind, at])], names=["kind", "pair", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind long, pair long, n long")
    total = np.zeros((2, len(CHARS) ** 2), np.int64)
    for r in rows.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        total[r["kind"], r["pair"]] = r["n"]
    return ratios(*total)


def excess(token: str, ratio) -> float:
    """Mean log-likelihood ratio of a token's character pairs."""
    at = [CHARS.index(c) for c in token]
    return sum(ratio[a][b] for a, b in zip(at, at[1:])) / max(1, len(at) - 1)


def spans_of(text: str, ratio) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    if ratio is None:
        return base
    more = [
        (m.start(), 3, m.end()) for m in TOKEN.finditer(text)
        if not _overlaps(base, m.start(), m.end()) and excess(m[0], ratio) > THRESHOLD
    ]
    return sorted(base + more)


def scan(docs: DataFrame, ratio) -> DataFrame:
    """doc_id, spans array<struct<kind, start, stop>> of every whole text, by start, then kind."""

    def make():
        return lambda texts: [[[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans_of(t or "", ratio)] for t in texts]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, make, "spans array<struct<kind: string, start: long, stop: long>>")


def masked(text: str | None, ratio, mark: str) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for a, _, b in spans_of(text, ratio):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, ratio, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans become one. Columns unchanged; n_chars follows where there."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    done = map_texts(docs.select(rest, F.col("text").cast("string").alias("text")), lambda: lambda texts: [[masked(t, ratio, mark) for t in texts]], "masked string")
    columns = [F.col("masked").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.length("masked").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*columns)
