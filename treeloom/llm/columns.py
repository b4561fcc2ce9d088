"""Names of columns: those of a caller's table may be anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of that name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(docs: DataFrame) -> list[Column]:
    """All columns of a table, as they are."""
    return [named(c) for c in docs.columns]


def unused(docs: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of the table has, in any case of its letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out
