"""Small tables with the columns of ``documents`` and others that could clash."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "key", "host", "keep", "copies", "bucket", "first", "hi", "tokens", "part", "digest", "rate", "slot", "value", "match", "a", "u", "v")
CLASH += ("__words", "__keep", "__id", "__again", "__digest", "__same", "__source", "__copies", "__verdict", "__f_empty", "__flags", "__host", "__n", "a.b", "x`y")


def documents(spark, rows, clash=False):
    """Rows are (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0", len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASH]) if clash else df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


PROSE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from tall green trees near the old stone bridge at noon".split()


def prose(n, shift=0):
    return " ".join(PROSE[(i * 7 + shift * 3 + i * i) % len(PROSE)] + ("" if i % 5 else str((i * 31 + shift) % 97)) for i in range(n))
