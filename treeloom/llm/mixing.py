"""Mixing sources to target weights by systematic sampling.

A document of source *s* is expected ``rate(s)`` times in the mixture, where the
rates make the characters drawn from each source meet its target share of the
budget.  Within a source the documents are put in the order of a seeded hash;
their expected copies are summed along that order, the source's random offset is
added, and a document is emitted once for each integer that its step of the sum
crosses.  A source so gets its expected number of copies to within one, whatever
the number of documents.

Expected copies are fixed-point integers (``2**-32`` of a copy), so sums are
exact, in any order, and the result does not depend on partitioning.  The prefix
sum is done in two levels: the hash splits every source into ``2**chunk_bits``
chunks of about equal size (1,024, or more where the corpus has above a billion
documents), chunk totals are summed along a source (a few rows
a source), and documents are summed within their chunk.  A hot source is thus
spread over all executors.

Defined results: a null source counts as the source ``''``; a null or empty text
has no characters but is drawn like the others; rows that repeat an id within a
source are one document, drawn together (their characters add up); null ids come
first in the hash order; a source whose documents are all empty, or with weight
0, is not drawn; a text counts with its whole length, whatever that is; an empty
table gives an empty table; ties of the hash are broken by the id.  Other
columns, whatever their names, pass through :func:`mix_documents` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.columns import own, unused
from treeloom.plans.staging import materialize

ONE = 1 << 32
SEED = "mix-1"


def _key(seed: str):
    """60 uniform bits from the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_rates(totals: DataFrame, weights: dict[str, float] | None, epochs: float, seed: str) -> DataFrame:
    """``(source, rate, offset)`` in fixed point, from ``(source, chars)``.

    Without ``weights`` a source weighs the square root of its characters, which
    damps large sources without flattening all to one size.
    """
    if weights is None:
        weight = F.round(F.sqrt("chars")).cast("long").cast("double")
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0))
    weighed = totals.withColumn("weight", weight)
    budget = weighed.filter("chars > 0 and weight > 0").agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    rate = F.floor(F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * (F.col("all_chars") / F.col("chars")) * F.lit(float(ONE))).cast("long")
    noise = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.col("source"))), 1, 8), 16, 10).cast("long")
    return weighed.filter("chars > 0 and weight > 0").crossJoin(F.broadcast(budget)).select("source", rate.alias("rate"), noise.alias("offset"))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED, chunk_bits: int | None = None) -> DataFrame:
    """``(doc_id, source, copies)`` of every document that is emitted at least once."""
    sized = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
    )
    units = sized.groupBy("source", "doc_id").agg(F.sum("chars").alias("chars"))
    units = materialize(units.withColumn("key", _key(seed)), "units")
    if chunk_bits is None:
        chunk_bits = max(10, math.ceil(math.log2(max(1, units.count()) / 1_000_000)))
    rates = source_rates(units.groupBy("source").agg(F.sum("chars").alias("chars")), weights, epochs, seed)
    chunked = units.select("source", "doc_id", "key", F.shiftright("key", 60 - chunk_bits).cast("int").alias("chunk"))
    along = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    # Crossings depend on the sum modulo one copy only, so no sum outgrows a long.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sum_before = F.coalesce(F.sum("n").over(along), F.lit(0)).cast("decimal(18,0)") * wide("rate") + wide("offset")
    starts = starts.join(rates, "source").withColumn("before", F.pmod(sum_before, F.lit(ONE)).cast("long")).drop("n")
    within = Window.partitionBy("source", "chunk").orderBy("key", F.col("doc_id").asc_nulls_first())
    placed = chunked.join(starts, ["source", "chunk"]).withColumn(
        "upto", F.col("before") + F.sum("rate").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    drawn = F.shiftright("upto", 32) - F.shiftright(F.col("upto") - F.col("rate"), 32)
    return placed.select("doc_id", "source", drawn.alias("copies")).filter("copies > 0")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with every row repeated as often as it is emitted.

    The text moves once, in the join with the copies, unless those are small
    enough for Spark to broadcast.
    """
    key, place, times, again = unused(docs, "__id", "__source", "__copies", "__again")
    drawn = copies(docs, **params).select(F.col("doc_id").alias(key), F.col("source").alias(place), F.col("copies").cast("int").alias(times))
    here = docs["doc_id"].eqNullSafe(drawn[key]) & (F.coalesce(docs["source"], F.lit("")) == drawn[place])
    emitted = docs.join(drawn, here).select(*own(docs), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(again))
    return emitted.select(*own(docs))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each emission, numbered within its document."""
    drawn = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))


def copies_sql(table: str = "documents", epochs: float = 1.0, seed: str = SEED) -> str:
    """CTEs that end in ``drawn(doc_id, source, copies)``, for the default weights."""
    hexed = lambda what, n: f"('0x' || substr(md5({what}), 1, {n}))::bigint"
    return f"""
units as (
  select coalesce(source, '') as source, doc_id, sum(coalesce(length(text), 0))::bigint as chars,
         {hexed(f"'{seed}:' || coalesce(doc_id::varchar, 'null')", 15)} as key
  from {table} group by 1, 2),
totals as (select source, sum(chars)::bigint as chars, round(sqrt(sum(chars)::bigint)) as weight from units group by source),
rates as (
  select source,
         floor(weight / (select sum(weight) from totals where chars > 0) * {epochs}::double
               * ((select sum(chars)::bigint from totals where chars > 0) / chars) * {ONE}.0::double)::bigint as rate,
         {hexed(f"'{seed}:offset:' || source", 8)} as offset_
  from totals where chars > 0),
placed as (
  select doc_id, source, rate,
         offset_ + rate * row_number() over (partition by source order by key, doc_id nulls first) as upto
  from units join rates using (source)),
drawn as (select doc_id, source, (upto >> 32) - ((upto - rate) >> 32) as copies from placed)"""


OP6_SQL = f"with {copies_sql()} select doc_id, source, unnest(range(1, copies + 1)) as copy_no from drawn where copies > 0"
