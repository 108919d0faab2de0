"""Scalar functions on names and texts, inside the JVM but for entropies() of whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of addresses, URLs and encoded literals, and address prefixes that do not count as public.
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = r"https?://[^\s\"'<>)\]]+"
HEXISH = r"^[0-9a-fA-F]{40,}$"
B64ISH = r"^[A-Za-z0-9+/=_-]{60,}$"
LOCAL_PREFIXES = ("127.", "0.", "10.", "192.168.", "255.")
PACKED_LINE = 500


def normalise(name: Column) -> Column:
    """Package name with runs of - _ . as one dash, lower case."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def slug(name: Column, length: int = 150) -> Column:
    """File-system-safe id; ASCII letters, digits and -_. stay."""
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit(length))


def public_ips(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(IP), F.lit(0))

    def is_local(ip: Column) -> Column:
        test = F.lit(False)
        for p in LOCAL_PREFIXES:
            test = test | ip.startswith(p)
        return test

    return F.filter(found, lambda ip: ~is_local(ip))


def literals(text: Column, pattern: str) -> Column:
    """Number of white-space tokens that match a pattern as a whole."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t.rlike(pattern))).cast("long")


def line_lengths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), F.length)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in the row: each distinct character's count is the length that its removal takes."""
    size = F.length(text)
    of = F.array_distinct(F.split(text, ""))
    counts = F.transform(F.filter(of, lambda c: c != ""), lambda c: size - F.length(F.replace(text, c, F.lit(""))))
    return F.when(size > 0, F.log2(size) - F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * F.log2(n)) / size)


def entropies():
    """The same for whole texts, as a function of a text column: code points are counted in Arrow batches, in time that does not depend on how many differ."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        import numpy as np

        def one(text):
            if not text:
                return None
            n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / len(text)
            return float(-(n * np.log2(n)).sum())

        return pd.Series([one(t) for t in texts], dtype="float64")

    return of


def non_ascii_share(text: Column) -> Column:
    """Share of characters beyond ASCII; the length counts as 1 at least."""
    kept = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.length(text) - kept) / F.greatest(F.length(text), F.lit(1))


def bounded_levenshtein(a: Column, b: Column, limit: int) -> Column:
    """Edit distance; limit + 1 where it is greater."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


# What a request to analyse a package looks like, words that are conversation, and a package spec.
NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
VERSION = r"(?:\s*(?:==|@|\s)\s*v?\d[\w.!+-]*)?"
REQUESTS = [
    rf"(?i)^(?:(?:please\s+)?(?:check|analy[sz]e|scan|test|inspect)\s+(?:package\s+)?|pip3?\s+install\s+)?({NAME}{VERSION})\s*[?.!]?$",
    rf"(?i)^is\s+({NAME}{VERSION})\s+(?:safe|malicious|malware|legit(?:imate)?|dangerous|ok|okay|clean)\s*\??$",
    rf"(?i)^(?:what|how)\s+about\s+({NAME}{VERSION})\s*\??$",
    rf"(?i)^and\s+({NAME}{VERSION})\s*\?$",
]
CHAT_WORDS = (
    "why", "how", "what", "explain", "more", "details", "elaborate", "really", "ok", "okay", "thanks", "thank", "thx", "yes", "no",
    "sure", "hmm", "and", "so", "continue", "go", "hi", "hello", "hey", "help", "it", "this", "that", "these", "those", "them", "they",
    "one", "package", "same", "again", "code", "evidence", "summary", "summarize", "summarise", "example", "examples",
)
SPEC = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=@ ]=?\s*v?([\w.!+-]+))?\s*$"


def requested(text: Column) -> Column:
    """The package spec that a turn asks to analyse, else null: the first form that fits decides."""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(F.trim(text), p, 1)), F.lit("")) for p in REQUESTS])
    name = F.lower(F.element_at(F.split(found, r"[\s=@]"), 1))
    return F.when(~name.isin(*CHAT_WORDS), found)


def route(text: Column) -> Column:
    """'analyze' for a request to analyse a package, else 'question'."""
    return F.when(requested(text).isNotNull(), "analyze").otherwise("question")


def parse_spec(text: Column) -> tuple[Column, Column]:
    """Package name and version of a spec, nulls where there are none."""
    return tuple(F.nullif(F.regexp_extract(F.trim(text), SPEC, i), F.lit("")) for i in (1, 2))
