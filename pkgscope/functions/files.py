"""Predicates and columns on file paths and untrusted identifiers, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of files by their role, suffixes of compiled files, and two patterns of test paths (they differ on purpose).
SETUP_FILES = ("setup.py", "setup.cfg", "pyproject.toml", "conftest.py", "__init__.py")
DOC_NAMES = ("readme", "readme.md", "readme.rst", "readme.txt")
LICENSE_NAMES = ("license", "license.txt", "license.md", "licence", "copying")
BINARY_SUFFIXES = (".so", ".dll", ".exe", ".dylib", ".pyd", ".bin", ".node", ".msi", ".scr")
SCAN_TEST_PATH = r"(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*\.py$|_test\.py$"
BEHAVIOUR_TEST_PATH = (
    r"(^|/)(tests?|testing|docs?|examples?|benchmarks?|tools|ci|\.github|\.circleci)(/|$)"
    r"|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"
)
DATE_IN_PATH = r"_(\d{4}-\d{2}-\d{2})-"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_metadata(path: Column) -> Column:
    """Files of pipelines and build tools, which say nothing of the author's code."""
    parts, name = F.split(path, "/"), file_name(path)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    listed = (name == ".meta.json") | (name == "PKG-INFO") | (name.startswith("package_info-") & name.endswith(".json"))
    return listed | F.exists(parents, lambda p: p.endswith(".egg-info"))


def suffix(path: Column) -> Column:
    """The last suffix of the file name with its dot, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def kinds(path: Column) -> dict[str, Column]:
    name = F.lower(file_name(path))
    return {
        "is_metadata": is_metadata(path), "is_scan_test": path.rlike(SCAN_TEST_PATH), "is_behaviour_test": path.rlike(BEHAVIOUR_TEST_PATH),
        "is_readme": name.isin(*DOC_NAMES), "is_license": name.isin(*LICENSE_NAMES), "is_binary": suffix(path).isin(*BINARY_SUFFIXES),
        "says_test": name.contains("test"),
    }


def reading_order(path: Column) -> list[Column]:
    """Order in which a package's files are read: setup files, then shallow ones, then by path."""
    return [~file_name(path).isin(*SETUP_FILES), F.size(F.split(path, "/")), path]


def date_in_path(path: Column) -> Column:
    """First _YYYY-MM-DD- of a path, else empty."""
    return F.regexp_extract(path, DATE_IN_PATH, 1)


def identifier(text: Column, length: int = 60, kept: str = r"[^\w./:-]") -> Column:
    """Untrusted text cut down to identifier characters; null gives an empty text."""
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), kept, ""), F.lit(length))


def release_slug(package: Column, version: Column, length: int = 150) -> Column:
    """File-system-safe id of a release; letters and digits of any script and -._ stay."""
    return F.left(F.regexp_replace(F.concat_ws("@", package, version), r"[^\p{L}\p{N}._-]", "_"), F.lit(length))


def snippet(text: Column, lines: int = 40, chars: int = 3000) -> Column:
    """The first lines of a text, cut at a number of characters, with an ellipsis where something is missing."""
    every = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    head = F.array_join(F.slice(every, 1, lines), "\n")
    cut = F.concat(F.left(head, F.lit(chars)), F.lit("\n…"))
    return F.when(F.length(head) > chars, cut).when(F.size(every) > lines, F.concat(head, F.lit("\n…"))).otherwise(head)


def text_of(content: Column, most: int = 2 << 20, size: Column | None = None) -> Column:
    """Bytes as text: null beyond ``most`` bytes, by the listed ``size`` where one is given; each bad sequence becomes one replacement character; every line end becomes \\n."""
    read = F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")
    return F.when((F.octet_length(content) if size is None else size) <= most, read)
