"""Identity, path and name expressions, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders whose files are no source of the project itself.
SKIPPED_FOLDERS = ("docs", "doc", "examples", "example", "vendor", "migrations", ".git")


def short_id(*parts: Column | str) -> Column:
    """First eight hex digits of the MD5 of the joined parts."""
    return F.substring(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 8)


def is_test_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    parts = F.split(path, "/")
    return name.startswith("test_") | name.endswith("_test.py") | F.array_contains(parts, "tests") | F.array_contains(parts, "test")


def is_source_path(path: Column) -> Column:
    """A Python file outside the skipped folders."""
    return path.endswith(".py") & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def module_name(path: Column) -> Column:
    """Dotted import path; null and empty paths give an empty name."""
    return F.replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\.py$", ""), F.lit("/"), F.lit("."))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def is_constant_name(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def hover_type(text: Column) -> Column:
    """Class named in a type checker's hover text, or null.

    What follows the last colon, without back quotes; unions, unknown types, names
    in lower case (built-ins) and anything but one word are refused.
    """
    edges = r"^[\s]+|[\s]+$"
    tail = F.regexp_replace(F.substring_index(text, ":", -1), edges, "")
    tail = F.regexp_replace(F.regexp_replace(tail, "^`+|`+$", ""), edges, "")
    fine = text.contains(":") & (tail != "") & ~tail.rlike("[ |]") & ~tail.isin("Unknown", "None", "Any") & ~tail.rlike(r"^\p{Ll}")
    return F.when(fine, tail)


def test_target_candidates(name: Column) -> Column:
    """Names that ``test_a_b_c`` may aim at, longest first: ``a_b_c``, ``a_b``, ``a``."""
    bare = F.substring(name, 6, 1_000_000)
    parts = F.split(bare, "_")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    return F.when(name.startswith("test_"), prefixes).otherwise(F.array().cast("array<string>"))
