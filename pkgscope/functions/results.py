"""The nested result of an analysis, as Column expressions on its struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_code(result: Column) -> Column:
    """The result with every piece of code made empty: similarity.matches[].query_code and known_code, file_scan.files[].hits[].code.

    Where there is no similarity or no scan, that stays null; places, lines and calls are kept.
    """
    def blank(x: Column, *fields: str) -> Column:
        for f in fields:
            x = x.withField(f, F.lit(""))
        return x

    similarity, scan = result["similarity"], result["file_scan"]
    matches = F.transform(similarity["matches"], lambda m: blank(m, "query_code", "known_code"))
    files = F.transform(scan["files"], lambda f: f.withField("hits", F.transform(f["hits"], lambda h: blank(h, "code"))))
    result = result.withField("similarity", F.when(similarity.isNotNull(), similarity.withField("matches", matches)))
    return result.withField("file_scan", F.when(scan.isNotNull(), scan.withField("files", files)))
