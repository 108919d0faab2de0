"""Hits in the lines of a text, indicators of a binary and signals of risky code, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exfiltration
from . import text as T

# Paths of secrets that point at a line, weights of a hit's kind, tokens that make a file worth reading past
# the cap, and weights of a file's kinds of danger (another map than that of hits).
SECRETS = [
    r"\.ssh[/\\]", r"id_rsa", r"id_ed25519", r"\.aws[/\\]credentials", r"\.kube[/\\]config",
    r"\.docker[/\\]config", r"\.pypirc", r"\.npmrc", r"\.git-credentials",
    r"Login Data", r"cookies\.sqlite", r"key4\.db", r"logins\.json", r"Local State",
    r"Chrome[/\\]User Data", r"wallet\.dat", r"Ethereum[/\\]keystore", r"Telegram Desktop",
    r"discord[^\n]{0,40}token", r"Exodus[/\\]", r"Electrum[/\\]",
]
HIT_WEIGHTS = {
    "hidden_name": 4, "secrets": 3, "exfil_host": 4, "packed_blob": 3,
    "exec": 3, "process": 3, "network": 2, "deserialize": 2, "decode": 2,
    "chmod": 2, "home": 1, "fs_walk": 1, "delete": 1, "env": 1, "silent_except": 1,
    "hardcoded_ip": 2, "dynamic_import": 1,
}
RISKY_TOKENS = (
    r"subprocess|os\.system|popen|exec\(|eval\(|b64decode|urlopen|"
    r"urlretrieve|requests\.(get|post)|socket\.|marshal|__import__|chmod|"
    r"startfile|decompress|fromhex|getenv|environ"
)
DANGER_WEIGHTS = {
    "hidden_name": 4, "exec": 3, "process": 3, "network": 2, "deserialize": 2,
    "decode": 2, "chmod": 2, "dynamic_import": 1, "home": 1, "fs_walk": 1,
    "delete": 1, "env": 1, "silent_except": 1,
}
# Textual signs of the kinds of danger.
DANGER_SIGNS = {
    "exec": r"\b(?:exec|eval)\(", "process": r"subprocess|os\.system|popen", "network": r"urlopen|requests\.(?:get|post)|socket\.",
    "decode": r"b64decode|fromhex|decompress", "chmod": r"chmod", "dynamic_import": r"__import__", "env": r"getenv|environ",
}
MIN_DENSITY_LOC = 50
SECRET, HOST = "(?i)" + "|".join(SECRETS), "(?i)" + "|".join(exfiltration.HOSTS)
PRINTABLE = r"[\x20-\x7e]{6,}"
# Every line end that a line of text may have, the pair of two first.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def line_hits(text: Column) -> Column:
    """Array of (category, line, call). A packed line is one hit; else a line gives its first secret, host and public address."""
    def found(kind: str, line: Column, call: Column) -> Column:
        return F.struct(F.lit(kind).alias("category"), (line + 1).alias("line"), call.alias("call"))

    def of(s: Column, i: Column) -> Column:
        packed = F.array(found("packed_blob", i, F.concat(F.length(s).cast("string"), F.lit(" chars"))))
        address = F.try_element_at(T.public_ips(s), F.lit(1))
        first = [("secrets", F.regexp_extract(s, SECRET, 0)), ("exfil_host", F.regexp_extract(s, HOST, 0)), ("hardcoded_ip", F.coalesce(address, F.lit("")))]
        each = F.array(*[found(kind, i, call) for kind, call in first])
        return F.when(F.length(s) > T.PACKED_LINE, packed).otherwise(F.filter(each, lambda h: h["call"] != ""))

    return F.flatten(F.transform(F.split(text, LINE_END), of))


def weighed(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HIT_WEIGHTS.items() for x in kv]), category)


def danger_score(hits: Column) -> Column:
    """Sum of the weights of the distinct categories."""
    kinds = F.array_distinct(F.transform(hits, lambda h: h["category"]))
    return F.aggregate(F.transform(kinds, weighed), F.lit(0), lambda s, w: s + w)


def shown_hits(hits: Column, most: int = 14) -> Column:
    """First hit of each category and line; the heaviest, then earliest ones up to ``most``, in the order of their lines."""
    firsts = F.filter(hits, lambda h, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda o: (o["category"] == h["category"]) & (o["line"] == h["line"])))
    keyed = F.transform(firsts, lambda h: F.struct((-weighed(h["category"])).alias("w"), h["line"].alias("line"), h["category"].alias("category"), h["call"].alias("call")))
    kept = F.slice(F.array_sort(keyed), 1, most)
    return F.array_sort(F.transform(kept, lambda h: F.struct(h["line"], h["w"], h["category"], h["call"])))


def printable(content: Column) -> Column:
    """The printable runs of six bytes or more of a binary, one a line."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(PRINTABLE), F.lit(0)), "\n")


def binary_indicators(content: Column) -> dict[str, Column]:
    """Counts over the printable runs of six bytes or more of a binary."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(PRINTABLE), F.lit(0))
    text = printable(content)
    urls = F.regexp_extract_all(text, F.lit(T.URL), F.lit(0))
    ips = F.filter(T.public_ips(text), lambda a: ~a.startswith("1.") & ~a.startswith("2.") & F.forall(F.split(a, r"\."), lambda x: x.cast("int") <= 255))
    return {
        "n_runs": F.size(runs).cast("long"), "n_urls": F.size(urls).cast("long"),
        "n_hosts": F.regexp_count(text, F.lit(HOST)).cast("long"), "n_ips": F.size(ips).cast("long"),
        "n_tlds": F.regexp_count(F.array_join(urls, " "), F.lit("(?i)" + "|".join(exfiltration.DOMAINS))).cast("long"),
    }


def string_signals(strings: Column) -> dict[str, Column]:
    """Entropy and shape of an array of literals; entropies of those of 20 characters or more, or of all where there is none."""
    long = F.filter(strings, lambda s: F.length(s) >= 20)
    considered = F.when(F.size(long) > 0, long).otherwise(strings)
    entropies = F.transform(considered, lambda s: F.coalesce(T.entropy(s), F.lit(0.0)))
    lengths = F.transform(strings, F.length)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(xs), F.lit(1))
    number = lambda pattern: F.size(F.filter(strings, lambda s: s.rlike(pattern))).cast("long")
    high = F.filter(considered, lambda s: (F.length(s) > 100) & (T.entropy(s) > 4.5))
    return {
        "entropy_mean": mean(entropies), "entropy_max": F.coalesce(F.array_max(entropies), F.lit(0.0)),
        "len_max": F.coalesce(F.array_max(lengths), F.lit(0)).cast("long"), "len_mean": mean(lengths),
        "n_hex": number(T.HEXISH), "n_base64": number(T.B64ISH), "n_high": F.size(high).cast("long"),
    }


def dangers(text: Column) -> Column:
    """Kinds of danger that a text shows signs of."""
    return F.filter(F.array(*[F.when(text.rlike(p), kind) for kind, p in DANGER_SIGNS.items()]), lambda k: k.isNotNull())


def danger_weight(kinds: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in DANGER_WEIGHTS.items() for x in kv])
    return F.aggregate(kinds, F.lit(0), lambda s, k: s + F.element_at(weights, k))


def density(count: Column, loc: Column) -> Column:
    """Per thousand lines, with a floor on a file's size."""
    return count * 1000 / F.greatest(loc, F.lit(MIN_DENSITY_LOC))


def confidence(score: Column, threshold: float) -> Column:
    """Distance from the threshold, scaled to 0 .. 1 on the side where the score lies."""
    up = (score - threshold) / max(1 - threshold, 1e-9)
    down = (threshold - score) / max(threshold, 1e-9)
    return F.least(F.greatest(F.when(score >= threshold, up).otherwise(down), F.lit(0.0)), F.lit(1.0))
