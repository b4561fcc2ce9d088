"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition turns its documents into one sorted run of entries
``(digest, check, bytes, doc_id)``: a 64-bit sort key, a SHA-256 that verifies
it and the length of the text.  The runs are then exchanged in binomial rounds:
in round *r* partition *p* keeps the entries whose *r*-th digest digit equals
its own *r*-th digit and sends the others to the partitions that differ from it
in that digit alone.  Every receiver merges the runs it now holds, in one pass, and
of entries with one digest, one check and one length keeps the smallest
document id.  Entries that share a digest but not the check are different texts
and are all kept.  After ``rounds`` rounds partition *p* owns the digest range
*p*: duplicates have met, most of them long before the last round, and no
partition ever holds more than its share, unlike a merge that ends in one
process.

Entries that lose are not merged on: they stay where they lost, flagged, and ride
along the later exchanges from a partition to itself, so a text with any number
of copies costs no partition more than its share.  A text that lost copies keeps
their number; losers meet only those winners again, to learn the identifier they
lost to in the end.

Only digests travel, never text.  A round is one shuffle by exact partition
number, so ``rounds`` shuffles of about 60 bytes a document.  Unless they are given,
fan-in and rounds follow the counted documents, so that a partition ends with
about a million of them (fan-in 8 and two rounds up to 64 million; then the
partitions grow in proportion to the documents, at a fan-in of 32 at most).

Defined results: a null text equals only null texts and an empty text only
empty ones; ids are compared as numbers, and a null id loses against any other;
rows that repeat id and text are one document (its repeats are dropped by
:func:`deduplicate`, and listed with the id as their own ``dup_of``); a text is
digested whole, whatever its length; an empty table gives an empty table; other
columns, whatever their names, pass through :func:`deduplicate` and are not
compared, so of rows with one id and one text but different other columns one
is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.columns import named, own, unused
from treeloom.plans.staging import materialize, release, ship

ENTRY = ["digest", "check", "bytes"]


def fast_digest(text: Column) -> Column:
    return F.xxhash64(text)


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = fast_digest) -> DataFrame:
    """``(doc_id, digest, check, bytes)`` of every document; bytes is -1 for a null text."""
    body = F.col(text)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        digest(body).alias("digest"),
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(bytes(32))).alias("check"),
        F.coalesce(F.octet_length(body).cast("long"), F.lit(-1).cast("long")).alias("bytes"),
    )


def _digit(value: Column, place: int, fan_in: int) -> Column:
    return F.pmod(F.floor(value / F.lit(fan_in**place)), F.lit(fan_in)).cast("int")


def shape_for(documents: int) -> tuple[int, int]:
    """Fan-in and rounds after which partitions hold about a million documents each."""
    slots = max(64, math.ceil(documents / 1_000_000))
    rounds = max(2, math.ceil(math.log(slots, 32)))
    return max(8, math.ceil(round(slots ** (1 / rounds), 9))), rounds


def merge_runs(digest: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of one merged run, sorted by digest, and where each text in it begins.

    The rows are sorted runs one after another, as a shuffle delivers them; the
    stable sort finds the runs and merges them.  Where digests meet, the check
    (four 64-bit words) and the size decide what is one text; ``missing`` marks null
    ids, which lose.  The first row of a text has its smallest id.
    """
    order = np.argsort(digest, kind="stable")
    met = digest[order]
    again = np.concatenate([[False], met[1:] == met[:-1]])
    shared = again | np.append(again[1:], False)
    some = order[shared]
    # within equal digests: by check and size, then the id that stays comes first
    some = some[np.lexsort((ids[some], missing[some], size[some], *check[some].T, digest[some]))]
    order[shared] = some
    same = np.zeros(len(order), bool)
    same[1:] = (digest[order][1:] == digest[order][:-1]) & (size[order][1:] == size[order][:-1]) & (check[order][1:] == check[order][:-1]).all(axis=1)
    return order, ~same


_RUN = "digest long, check binary, bytes long, keep_id long, copies long, slot int"


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a partition as one; ``copies`` is 0 for what has lost."""
    held = []
    for batch in batches:
        live = pa.compute.greater(batch.column("copies"), 0)
        lost = batch.filter(pa.compute.invert(live))
        if lost.num_rows:
            yield lost
        held.append(batch.filter(live))
    held = [b for b in held if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    digest, size = table.column("digest").to_numpy(), table.column("bytes").to_numpy()
    check = np.frombuffer(b"".join(table.column("check").to_pylist()), np.int64).reshape(-1, 4)
    missing = table.column("keep_id").is_null().to_numpy(zero_copy_only=False)
    ids = table.column("keep_id").fill_null(0).to_numpy()
    order, first = merge_runs(digest, check, size, ids, missing)
    copies = table.column("copies").to_numpy()[order]
    totals = np.zeros(len(order), np.int64)
    totals[first] = np.add.reduceat(copies, np.flatnonzero(first))
    merged = table.take(pa.array(order))
    yield from merged.set_column(merged.schema.get_field_index("copies"), "copies", pa.array(totals)).to_batches()


def tree_merge(runs: DataFrame, fan_in: int = 8, rounds: int = 2) -> DataFrame:
    """``(digest, check, bytes, keep_id, copies)``: for each text one row with its smallest id and the number of its rows, and a row with 0 copies for each other.

    The partition number of an entry is a mixed-radix number of ``rounds``
    digits.  It starts as the partition that read the document and ends as the
    range of its digest, one digit a round.  What has lost keeps its number.
    """
    ship(runs.sparkSession)
    slots = fan_in**rounds
    target = F.pmod(F.xxhash64("digest"), F.lit(slots)).cast("int")
    start = runs.select(*ENTRY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"), F.pmod(F.spark_partition_id(), F.lit(slots)).cast("int").alias("slot"))
    state = start.mapInArrow(_level, _RUN)
    for place in range(rounds):
        moved = F.col("slot") + (_digit(target, place, fan_in) - _digit(F.col("slot"), place, fan_in)) * F.lit(fan_in**place)
        slot = F.when(F.col("copies") > 0, moved).otherwise(F.col("slot")).cast("int")
        state = state.select(*ENTRY, "keep_id", "copies", slot.alias("slot")).repartitionById(slots, F.col("slot")).mapInArrow(_level, _RUN)
    return state.select(*ENTRY, "keep_id", "copies")


def _lost(docs: DataFrame, fan_in: int | None, rounds: int | None, digest: Callable[[Column], Column]) -> DataFrame:
    """Stored ``(doc_id, digest, keep_id)``, a row for each row that isn't kept."""
    run = materialize(entries(docs, digest=digest), "digests")
    shape = shape_for(run.count())
    merged = materialize(tree_merge(run, fan_in or shape[0], rounds or shape[1]).filter("copies <> 1"), "merged")
    release(run)
    winners = merged.filter("copies > 1").select(*ENTRY, F.col("keep_id").alias("winner"))
    lost = merged.filter("copies = 0").join(winners, ENTRY).select(F.col("keep_id").alias("doc_id"), "digest", F.col("winner").alias("keep_id"))
    stored = materialize(lost, "copies")
    release(merged)
    return stored


def duplicates(docs: DataFrame, fan_in: int | None = None, rounds: int | None = None, digest: Callable[[Column], Column] = fast_digest) -> DataFrame:
    """``(doc_id, dup_of)`` for each document that repeats the text of a smaller id.

    A row beyond the first with one id and text is listed with ``dup_of`` equal
    to ``doc_id``.
    """
    return _lost(docs, fan_in, rounds, digest).select("doc_id", F.col("keep_id").alias("dup_of"))


def deduplicate(docs: DataFrame, fan_in: int | None = None, rounds: int | None = None) -> DataFrame:
    """``docs`` without the rows whose text a smaller id (or an equal row) already has.

    The list of dropped rows is joined by Spark's choice: broadcast while it is
    below the session's threshold, a shuffled anti join beyond.
    """
    key, mark, again = unused(docs, "__id", "__digest", "__same")
    found = _lost(docs, fan_in, rounds, fast_digest).select(
        F.col("doc_id").alias(key), F.col("digest").alias(mark), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(again)
    )
    digest = fast_digest(docs["text"])

    def matches(other: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other[key]) & (digest == other[mark])

    rest = docs.join(found, matches(found), "left_anti")
    # of rows that repeat the id and text that stay, one
    repeats = found.filter(F.col(again)).distinct()
    if repeats.isEmpty():
        return rest
    once = docs.join(repeats, matches(repeats), "left_semi").withColumn(mark, fast_digest(named("text")))
    return rest.union(once.dropDuplicates(["doc_id", mark]).select(*own(docs)))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
select doc_id, dup_of from (
  select doc_id, min(doc_id) over (partition by text) as dup_of from documents)
where doc_id <> dup_of"""
