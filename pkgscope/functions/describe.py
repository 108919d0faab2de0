"""Measured values put into words that cannot be misread, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How columns that say yes or no are named.
YES_NO = r"^(pkg_has_|install_has_)|(_cmdclass|_subclass)$"


def trimmed(s: Column) -> Column:
    """A decimal without the zeros that say nothing."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def short(x: Column) -> Column:
    """A number with four significant digits and no needless zeros; with an exponent below 1e-4 and from 1e4 on."""
    size = F.abs(x)
    # The number of digits before the point, after rounding to four, decides.
    digits = F.when(size > 0, F.floor(F.log10(size))).otherwise(0).cast("int")
    mantissa = F.bround(size / F.pow(F.lit(10.0), digits), 3)
    exponent = F.when(mantissa >= 10, digits + 1).otherwise(digits)
    mantissa = F.when(mantissa >= 10, mantissa / 10).otherwise(mantissa)
    science = F.concat(trimmed(F.format_string("%.3f", mantissa)), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = trimmed(F.format_string("%.7f", mantissa * F.pow(F.lit(10.0), exponent)))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when((exponent < -4) | (exponent >= 4), science).otherwise(plain))


def whole(x: Column) -> Column:
    """A count with all its digits."""
    return x.cast("long").cast("string")


def observation(feature: Column, value: Column, number: Callable[[Column], Column] = short) -> Column:
    """What was measured, as ``number`` writes it; that nothing was found is said in words."""
    return F.when(feature.rlike(YES_NO), F.when(value != 0, "present").otherwise("NOT present")).when(value == 0, "0 (none found)").otherwise(number(value))


def whole_percent(x: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(100 * x, 0)), F.lit("%"))


def training(feature: Column, value: Column, context: dict[str, Column], number: Callable[[Column], Column] = short) -> Column:
    """One sentence that compares a value with the training data; context: tail, malicious_share, benign_share, ratio, n_malicious, n_benign."""
    c = context
    had = F.when(feature.rlike(YES_NO), F.when(value != 0, "had this").otherwise("lacked this")).when((value == 0) & (c["tail"] == "le"), "had none").otherwise(
        F.concat(F.when(c["tail"] == "le", "had at most ").otherwise("had at least "), number(value))
    )
    lean = F.when(c["ratio"] >= 1.05, F.concat(trimmed(F.format_string("%.2f", c["ratio"])), F.lit("x more common among malware"))).when(
        c["ratio"] <= 0.95, F.concat(F.format_string("%.1f", F.bround(1 / F.greatest(c["ratio"], F.lit(1e-3)), 1)), F.lit("x more common among benign packages"))
    ).otherwise("about equally common in both")
    count = lambda n: F.format_number(n, 0)
    return F.concat(
        whole_percent(c["malicious_share"]), F.lit(" of the "), count(c["n_malicious"]), F.lit(" malicious and "), whole_percent(c["benign_share"]), F.lit(" of the "), count(c["n_benign"]),
        F.lit(" benign training packages "), had, F.lit(" ("), lean, F.lit(")"),
    )
