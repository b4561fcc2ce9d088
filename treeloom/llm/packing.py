"""Vector bin packing of training examples.

An example is a vector of three sizes: tokens, segments and loss-bearing tokens.
A bin (one training sequence) has a limit on each.  Bins are filled one after
another by the dot-product heuristic (Panigrahy et al., 2011): of the examples
that still fit, the one with the largest weighted inner product of its sizes and
the bin's remaining capacity goes in, where the weights are the mean demand for
each size in units of its limit; when nothing fits, the next bin is opened.

Examples are dealt to groups of about ``group_size`` by a hash, and each group is
packed by itself, in parallel; a group leaves about one bin part-filled, so the
loss is one bin in some hundreds at any size.  Within a group the order is fixed
by size and id, so the result does not depend on partitioning.

Defined results: an example above a limit has a bin of its own, marked ``over``;
a null text has no tokens; turns with a null conversation id form one example
with a null id; roles other than ``assistant`` (null too) bear no loss; repeated
rows are turns (or documents) of their own; ties go to the smaller id; texts are
tokenized whole, and a conversation too long for a bin is an example above a limit;
an empty table gives an empty table; other columns are not looked at.

A group is one task's work, or one after another of a task's where there are more
than ``TASKS`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import tokenizing
from treeloom.plans.staging import materialize, ship

#: Tokens, segments and loss-bearing tokens of a sequence of instruction data.
LIMITS = (8192, 32, 4096)
#: The same for documents, all of whose tokens bear loss.
DOCUMENT_LIMITS = (8192, 32, 8192)
#: Partitions of the shuffle that deals examples to groups.
TASKS = 16_384


def fill(sizes: np.ndarray, limits: tuple[int, int, int]) -> list[list[int]]:
    """Bins as lists of row numbers; rows of ``sizes`` are in order of preference on ties."""
    capacity = np.array(limits, np.int64)
    over = (sizes > capacity).any(axis=1)
    bins = [[int(i)] for i in np.flatnonzero(over)]
    alive = np.flatnonzero(~over)
    if not len(alive):
        return bins
    share = sizes[alive] / capacity
    weight = share.mean(axis=0)
    weight = weight / weight.sum() if weight.sum() else np.ones(3)
    weighted = share * weight
    left = np.ones(len(alive), bool)
    while left.any():
        # the examples that are placed are dropped now and then, to keep scans short
        if left.sum() * 2 < len(alive):
            alive, share, weighted, left = alive[left], share[left], weighted[left], left[left]
        room, own = capacity.copy(), []
        own_sizes = sizes[alive]
        fits = left.copy()
        while True:
            score = np.where(fits, weighted @ (room / capacity), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                break
            own.append(int(alive[best]))
            left[best] = fits[best] = False
            room = room - own_sizes[best]
            fits &= (own_sizes <= room).all(axis=1)
            if not fits.any():
                break
        bins.append(own)
    return bins


_OUT = "bin long, slot int, start long, id long, part int, tokens long, segments long, loss_tokens long, over boolean"


def pack(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, group_size: int = 4096) -> DataFrame:
    """Places of ``examples(id, part, deal, tokens, segments, loss_tokens)`` in bins.

    ``deal`` is any hash that spreads the examples.  ``start`` is the token at
    which an example begins in its bin.
    """
    ship(examples.sparkSession)
    stored = materialize(examples, "examples")
    groups = max(1, math.ceil(stored.count() / group_size))
    dealt = stored.withColumn("grp", F.pmod(F.xxhash64("deal"), F.lit(groups)).cast("long"))
    columns = ["grp", "tokens", "segments", "loss_tokens", "id", "part"]
    order = [F.desc("tokens"), F.desc("segments"), F.desc("loss_tokens"), F.col("id").asc_nulls_first(), "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            group, ids, part = table.column("grp").to_numpy(), table.column("id"), table.column("part").to_numpy()
            sizes = np.stack([table.column(c).to_numpy() for c in columns[1:4]], axis=1).reshape(-1, 3)
            rows, bins, slots, starts = [], [], [], []
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for a, b in zip(edge, np.append(edge[1:], len(group))):
                for number, own in enumerate(fill(sizes[a:b], limits)):
                    at = np.array(own, np.int64) + a
                    rows.append(at)
                    bins.append(np.full(len(at), (int(group[a]) << 24) + number))
                    slots.append(np.arange(len(at), dtype=np.int32))
                    starts.append(np.concatenate([[0], np.cumsum(sizes[at, 0])[:-1]]))
            take = np.concatenate(rows)
            placed = sizes[take]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(bins)),
                    pa.array(np.concatenate(slots)),
                    pa.array(np.concatenate(starts).astype(np.int64)),
                    ids.take(pa.array(take)).combine_chunks(),
                    pa.array(part[take].astype(np.int32)),
                    *(pa.array(placed[:, k]) for k in range(3)),
                    pa.array((placed > np.array(limits)).any(axis=1)),
                ],
                ["bin", "slot", "start", "id", "part", "tokens", "segments", "loss_tokens", "over"],
            )

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 4 * group_size:
                table = pa.Table.from_batches(held)
                group = table.column("grp").to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    # by number, since adaptive execution would merge these by their few bytes, though they are much work
    tasks = min(groups, TASKS)
    placed = dealt.select(*columns).repartitionById(tasks, F.pmod("grp", F.lit(tasks)).cast("int"))
    return placed.sortWithinPartitions("grp", *order).mapInArrow(run, _OUT)


def count_tokens(rows: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """``rows`` with the text replaced by its number of ``tokens``."""
    rest = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = tokenizing.counts(batch.column(len(rest)).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n)], [*rest, "tokens"])

    ship(rows.sparkSession)
    return rows.select(*rest, text).mapInArrow(run, schema)


def conversation_examples(turns: DataFrame, tokenizer: str = tokenizing.DEFAULT_FILE) -> DataFrame:
    """One example for each conversation; every turn costs one token more, for its end."""
    narrow = turns.select(F.col("conv_id").cast("long").alias("id"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"), "text")
    sized = count_tokens(narrow, "text", tokenizer).withColumn("tokens", F.col("tokens") + 1)
    whole = sized.groupBy("id").agg(
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.when(F.col("learn"), F.col("tokens")).otherwise(0)).cast("long").alias("loss_tokens"),
    )
    return whole.select("id", F.lit(0).alias("part"), F.xxhash64("id").alias("deal"), "tokens", "segments", "loss_tokens")


def document_examples(docs: DataFrame, limits: tuple[int, int, int] = DOCUMENT_LIMITS, tokenizer: str = tokenizing.DEFAULT_FILE) -> DataFrame:
    """Examples of whole documents; longer ones are cut into parts that fit a bin.

    All tokens of a document bear loss, so a part has at most the smaller of the
    two token limits.
    """
    most = min(limits[0], limits[2])
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("mark"), "text")
    sized = count_tokens(narrow, "text", tokenizer).withColumn("tokens", F.col("tokens") + 1)
    last = F.floor((F.col("tokens") - 1) / most).cast("int")
    cut = sized.select("id", "mark", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    size = F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("part").cast("long") * most)
    return cut.select("id", "part", F.xxhash64("mark", "part").alias("deal"), size.alias("tokens"), F.lit(1).cast("long").alias("segments"), size.alias("loss_tokens"))


def op10_vector_packing(spark, sf_dir: str) -> DataFrame:
    placed = pack(conversation_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return placed.withColumnRenamed("id", "conv_id").drop("part")
