"""Near-duplicate groups by SimHash, filtered with pivot distance tables.

A document's fingerprint has 128 bits: the signs of the sum of the +-1 hash
vectors of its distinct words (lower case, whole text).  Two documents are near
duplicates when their fingerprints differ in at most ``radius`` bits; groups are
the connected components of that relation.

1. *Fingerprints* are made in one pass over the text (Arrow batches, one hash
   per distinct word of a worker).  Documents with equal fingerprints are linked
   to the smallest id; one of them goes on.
2. *Buckets.* Distances of random fingerprints concentrate, so distances to
   pivots cannot key a join at a useful radius (neighbouring cells of the pivot
   grid would cover almost everything).  Pairs are therefore brought together
   by ``tables`` samples of ``key_bits`` bits, each probed at its own key and
   with one or both of the two bits flipped whose sums are nearest to zero,
   since those are the bits in which near duplicates differ.
3. *Pivot tables.* In each bucket the distances of its members to ``2 * 128``
   reference fingerprints (the rows of a Hadamard matrix and their shifts by a
   seeded mask) are precomputed.  By the triangle inequality a pair whose
   coordinates differ by more than ``radius`` anywhere is too far apart and is
   discarded.  A task computes the row of a fingerprint once for all buckets it
   has in hand; to carry the 256 bytes of a row with each key would multiply the
   shuffle by nine, and a row is one matrix product of 33,000 operations.
4. *Verification.* The survivors' Hamming distance is computed exactly.
5. Links become one star a task, and stars are joined to components by
   alternating large-star and small-star rounds (Kiveris et al., 2014), each
   written to the shared folder.  Minima are combined before the shuffle, so a hub
   is no task's burden.

No bucket is capped.  In one of more than ``SMALL`` members a breadth-first sweep
over the pivot table finds the same components without listing all pairs.  One of
more than ``BLOCK`` is passed on as it streams by, cut into blocks, and each two
blocks are swept against each other in a task of their own.

*Size.* ``sizing`` takes the bits of a key from the number of documents, so that a
bucket has ``CROWD`` chance members at most, and adds tables for each bit more than
24, so that a pair at the radius meets in as many tables as with 24 bits, and a
nearer one in more: recall does not fall with the size of the corpus.

Defined results: a document without a word (null, empty or only punctuation) has
no fingerprint and is nobody's duplicate; a null id is not compared and its row
is kept; rows that repeat an id are one document, compared by its smallest fingerprint,
and stay or go together; texts are read whole; an empty table gives an empty
table; ties go to the smallest id; other columns, whatever their names, pass
through :func:`keep_one` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.columns import unused
from treeloom.plans.staging import materialize, release, ship

BITS = 128
#: Buckets up to so many members are compared pair by pair.
SMALL = 32
#: Members of a bucket that one task sweeps; larger buckets are cut into blocks of so many.
BLOCK = 4096
#: Members that a bucket has by chance, at most, on average.
CROWD = 16
WORD = re.compile(r"\w+")


def sample_tables(tables: int, key_bits: int, seed: int = 7) -> np.ndarray:
    """Bit positions of every table, one row each."""
    rng = np.random.RandomState(seed)
    return np.array([rng.choice(BITS, key_bits, replace=False) for _ in range(tables)])


class _Words(dict):
    """Row number of each word's hash vector; hashes words on first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.digests: list[bytes] = []
        self.rows = np.zeros((0, BITS), np.int8)

    def __missing__(self, word: str) -> int:
        import xxhash

        at = self[word] = len(self)
        self.digests.append(xxhash.xxh128_digest(word.encode("utf-8", "surrogatepass")))
        return at

    def vectors(self) -> np.ndarray:
        if self.digests:
            fresh = np.frombuffer(b"".join(self.digests), np.uint8).reshape(-1, BITS // 8)
            self.rows = np.concatenate([self.rows, (np.unpackbits(fresh, axis=1).astype(np.int8) << 1) - 1])
            self.digests = []
        return self.rows


def bit_sums(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the hash vectors of each text, and its number of distinct words."""
    index = words.__getitem__
    sums, counts, rows, lengths, held = [], [], [], [], 0

    def flush() -> None:
        nonlocal rows, lengths, held
        if lengths:
            flat = np.fromiter((i for r in rows for i in r), np.int64, held)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sums.append(np.add.reduceat(words.vectors()[flat], starts, axis=0, dtype=np.int32))
        rows, lengths, held = [], [], 0

    for text in texts:
        own = [*map(index, set(WORD.findall(text.lower())))] if text else []
        counts.append(len(own))
        if own:
            rows.append(own)
            lengths.append(len(own))
            held += len(own)
            if held > 100_000:
                flush()
    flush()
    n = np.array(counts, np.int64)
    out = np.zeros((len(texts), BITS), np.int32)
    if sums:
        out[n > 0] = np.concatenate(sums)
    return out, n


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 128 zeros and ones as two 64-bit integers each."""
    return np.packbits(bits.astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def unpack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([hi, lo], axis=1).astype(">i8").view(np.uint8).reshape(-1, BITS // 8), axis=1)


def weakest(sums: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each table the two places in its key whose sums are nearest to zero."""
    size = np.abs(sums)
    found = [np.argsort(size[:, t], axis=1, kind="stable")[:, :2] for t in tables]
    return np.concatenate(found, axis=1).astype(np.uint8)


_PRINTS = "doc_id long, hi long, lo long, weak binary"


def fingerprints(docs: DataFrame, tables: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            if len(words) > 300_000:
                words = _Words()
            sums, n = bit_sums(batch.column(1).to_pylist(), words)
            has = n > 0
            packed, weak = pack(sums[has] > 0), weakest(sums[has], tables)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(has)).cast(pa.int64()),
                    pa.array(packed[:, 0]),
                    pa.array(packed[:, 1]),
                    pa.array([row.tobytes() for row in weak], pa.binary()),
                ],
                ["doc_id", "hi", "lo", "weak"],
            )

    ship(docs.sparkSession)
    narrow = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, _PRINTS)


def keys_of(bits: np.ndarray, weak: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The four keys of each fingerprint in each table; the table is in the high bits."""
    key_bits = tables.shape[1]
    places = np.int64(1) << np.arange(key_bits, dtype=np.int64)
    out = np.empty((len(bits), len(tables), 4), np.int64)
    for t, positions in enumerate(tables):
        key = bits[:, positions].astype(np.int64) @ places + (np.int64(t) << np.int64(key_bits))
        one, two = places[weak[:, 2 * t]], places[weak[:, 2 * t + 1]]
        out[:, t] = np.stack([key, key ^ one, key ^ two, key ^ one ^ two], axis=1)
    return out.reshape(len(bits), -1)


def probes(unique: DataFrame, tables: np.ndarray) -> DataFrame:
    """``(bucket, doc_id, hi, lo)`` for all keys of all fingerprints."""
    width = 4 * len(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, hi, lo = (batch.column(i).to_numpy() for i in range(3))
                weak = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
                keys = keys_of(unpack(hi, lo), weak, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), *(pa.array(np.repeat(x, width)) for x in (ids, hi, lo))],
                    ["bucket", "doc_id", "hi", "lo"],
                )

    return unique.select("doc_id", "hi", "lo", "weak").mapInArrow(run, "bucket long, doc_id long, hi long, lo long")


def references(seed: int = 11) -> np.ndarray:
    """Reference fingerprints as +-1 rows: a Hadamard matrix, and the same shifted."""
    h = np.ones((1, 1), np.float32)
    while len(h) < BITS:
        h = np.block([[h, h], [h, -h]])
    shift = np.random.RandomState(seed).choice(np.array([-1, 1], np.float32), BITS)
    return np.concatenate([h, h * shift])


def pivot_table(hi: np.ndarray, lo: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference, one byte each.

    Made in slices: the products in floats take some fourteen times the memory of the table.
    """
    table = np.empty((len(hi), len(refs)), np.uint8)
    for at in range(0, len(hi), 4096):
        own = slice(at, at + 4096)
        signs = unpack(hi[own], lo[own]).astype(np.float32) * 2 - 1
        table[own] = (BITS - signs @ refs.T) / 2
    return table


def hamming(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    high = np.bitwise_count((hi[i] ^ hi[j]).view(np.uint64)).astype(np.int64)
    return high + np.bitwise_count((lo[i] ^ lo[j]).view(np.uint64))


def _apart(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """True where some coordinate of the pair differs by more than ``radius``.

    Coordinates are at most 128, so a difference within the radius, and no other,
    comes to ``2 * radius`` at most when it is raised by the radius modulo 256.
    """
    return (table[i] - table[j] + np.uint8(radius)).max(axis=1) > 2 * radius


def sweep(hi: np.ndarray, lo: np.ndarray, table: np.ndarray, sides: list[np.ndarray], radius: int, stats: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that connect what is near, among the rows of one side or across two.

    Breadth first: what is near to a row leaves the rest and is compared itself, so
    every row is compared once with what is left then.  ``table`` has the pivot rows.
    """
    one, two = [], []
    rest = [np.asarray(s) for s in sides]
    other = len(sides) - 1
    pivots = [np.ascontiguousarray(table[r].T) for r in rest]  # a row each pivot
    spare = np.empty(max(p.size for p in pivots), np.uint8)
    while len(rest[0]):
        front, rest[0], pivots[0] = [(int(rest[0][0]), 0)], rest[0][1:], pivots[0][:, 1:]
        while front:
            at, side = front.pop()
            across = other - side
            if not len(rest[across]):
                continue
            stats["pairs"] += len(rest[across])
            raised = spare[: pivots[across].size].reshape(pivots[across].shape)
            np.subtract(pivots[across], (table[at] - np.uint8(radius))[:, None], out=raised)
            found = np.flatnonzero(np.maximum.reduce(raised, axis=0) <= 2 * radius)
            stats["survivors"] += len(found)
            near = found[hamming(hi, lo, np.full(len(found), at), rest[across][found]) <= radius]
            if len(near):
                rows = rest[across][near]
                one.append(np.full(len(rows), at))
                two.append(rows)
                front.extend((int(r), across) for r in rows)
                left = np.ones(len(rest[across]), bool)
                left[near] = False
                rest[across], pivots[across] = rest[across][left], pivots[across][:, left]
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two)


def links(bucket: np.ndarray, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Verified pairs that connect what is near in the buckets (sorted by bucket)."""
    stats = {"pairs": 0, "survivors": 0, "near": 0}
    if not len(bucket):
        return ids[:0], ids[:0], stats
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(edge, len(bucket)))
    member = np.repeat(size > 1, size)
    if not member.any():
        return ids[:0], ids[:0], stats
    bucket, ids, hi, lo = bucket[member], ids[member], hi[member], lo[member]
    size = size[size > 1]
    edge = np.concatenate([[0], np.cumsum(size)[:-1]])
    # One pivot row for each document, though it is in many buckets.
    _, first, row = np.unique(ids, return_index=True, return_inverse=True)
    table = pivot_table(hi[first], lo[first], refs)
    found = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        found[0].append(ids[i])
        found[1].append(ids[j])

    small = np.repeat(size <= SMALL, size)
    i = np.flatnonzero(small)
    for step in range(1, SMALL):
        i = i[i + step < len(bucket)]
        i = i[bucket[i] == bucket[i + step]]
        if not len(i):
            break
        for at in range(0, len(i), 50_000):
            a = i[at : at + 50_000]
            a = a[ids[a] != ids[a + step]]
            stats["pairs"] += len(a)
            a = a[~_apart(table, row[a], row[a + step], radius)]
            stats["survivors"] += len(a)
            a = a[hamming(hi, lo, a, a + step) <= radius]
            keep(a, a + step)
    for start, length in zip(edge[size > SMALL], size[size > SMALL]):
        at = slice(start, start + length)
        a, b = sweep(hi[at], lo[at], table[row[at]], [np.arange(length)], radius, stats)
        keep(a + start, b + start)
    a, b = np.concatenate(found[0]), np.concatenate(found[1])
    stats["near"] = len(a)
    return a, b, stats


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components in which every document points to its smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


_FOUND = "a long, b long, bucket long, hi long, lo long, block int"


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], ["a", "b", "bucket", "hi", "lo", "block"])


def _members(rows: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    bucket, ids, hi, lo = rows
    columns = [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(bucket), pa.array(hi), pa.array(lo), pa.array(block.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "hi", "lo", "block"])


def near_links(entries: DataFrame, radius: int, chunk: int = 200_000, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, b < a: stars over the verified pairs of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            size = np.diff(np.append(edge, rows.shape[1]))
            for start, length in zip(edge[size > block], size[size > block]):
                yield _members(rows[:, start : start + length], np.arange(length) // block)
            a, b, _ = links(*rows[:, np.repeat(size <= block, size)], refs, radius)
            yield _found(*stars(a, b))

        held: list[np.ndarray] = []
        total = passed = 0
        large = None  # the bucket whose members are passed on
        for batch in batches:
            fresh = np.stack([c.to_numpy() for c in batch.columns])
            if large is not None:
                end = int(np.searchsorted(fresh[0], large, "right"))
                if end:
                    yield _members(fresh[:, :end], (passed + np.arange(end)) // block)
                    passed, fresh = passed + end, fresh[:, end:]
                if not fresh.shape[1]:
                    continue
                large = None
            held.append(fresh)
            total += fresh.shape[1]
            if total > chunk:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last bucket may go on
                if cut:
                    yield from solve(rows[:, :cut])
                rows = rows[:, cut:]
                if rows.shape[1] > block:
                    large, passed = rows[0, -1], rows.shape[1]
                    yield _members(rows, np.arange(passed) // block)
                    rows = rows[:, :0]
                held, total = [rows], rows.shape[1]
        if total:
            yield from solve(np.concatenate(held, axis=1))

    placed = entries.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    found = materialize(placed.mapInArrow(run, _FOUND), "links")
    pairs = found.filter("b is not null").select("a", "b")
    members = found.filter("b is null").select("bucket", "block", F.col("a").alias("doc_id"), "hi", "lo")
    blocks = members.groupBy("bucket").agg((F.max("block") + 1).cast("long").alias("blocks"))
    tasks = blocks.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0]
    return pairs if tasks is None else pairs.union(_block_links(members, blocks, radius, int(tasks)))


def _block_links(members: DataFrame, blocks: DataFrame, radius: int, tasks: int) -> DataFrame:
    """Links of large buckets: every two blocks of a bucket meet in a group of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            block, ids, hi, lo = rows[3:]
            numbers = np.unique(block)
            a, b = sweep(hi, lo, pivot_table(hi, lo, refs), [np.flatnonzero(block == n) for n in numbers], radius, {"pairs": 0, "survivors": 0})
            return pa.RecordBatch.from_arrays([*map(pa.array, stars(ids[a], ids[b]))], ["a", "b"])

        held = np.zeros((7, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            ends = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *ends], ends):
                yield solve(held[:, start:end])
            if len(ends):
                held = held[:, ends[-1] :]
        if held.shape[1]:
            yield solve(held)

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    spread = members.join(blocks, "bucket").select("bucket", F.col("block").cast("long").alias("block"), "doc_id", "hi", "lo", other)
    met = spread.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "doc_id", "hi", "lo")
    # by number: the work is in the pairs, and adaptive execution goes by bytes
    placed = met.repartition(min(tasks, 10_000), "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "block")
    return placed.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "stars", then_release: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``(doc_id, keep_id)`` with the smallest id of each component, for all other members.

    Alternates large-star and small-star until nothing changes; every round is
    written, so neither plan nor lineage grows.  ``then_release`` are staged tables
    that nothing but ``edges`` reads.
    """
    state = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct(), label)
    for table in then_release:
        release(table)
    mark = _checksum(state)
    while True:
        both = state.select(F.col("v").alias("n"), F.col("u").alias("m")).union(state.select(F.col("u").alias("n"), F.col("v").alias("m")))
        lowest = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(lowest, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).filter("u < v").distinct()
        large = materialize(large, label)
        lowest = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(lowest, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("low").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u")))).alias("e"))
        after = materialize(small.select("e.v", "e.u").filter("u < v").distinct(), label)
        seen = _checksum(after)
        release(state)
        release(large)
        state = after
        if seen == mark:
            return state.select(F.col("v").alias("doc_id"), F.col("u").alias("keep_id"))
        mark = seen


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def sizing(documents: int, radius: int = 20) -> tuple[int, int]:
    """Number of tables and bits of a key for a corpus.

    14 tables of 24 bits while ``documents`` are at most ``CROWD`` for each key; then a
    bit more for each doubling.  Each bit more makes a pair at the radius miss in a
    ``radius / 128`` of the tables where it met, so there are as many more tables.
    """
    key_bits = max(24, math.ceil(math.log2(max(1, documents / CROWD))))
    return math.ceil(14 * (BITS / (BITS - radius)) ** (key_bits - 24)), key_bits


def near_duplicates(docs: DataFrame, radius: int = 20, tables: int | None = None, key_bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id, keep_id)`` for every document that a smaller id of its group stands for."""
    sized = sizing(docs.select("doc_id").count(), radius) if tables is None or key_bits is None else (tables, key_bits)
    samples = sample_tables(*(given or default for given, default in zip((tables, key_bits), sized)))
    prints = materialize(fingerprints(docs, samples), "prints")
    # equal fingerprints are combined before the shuffle, however many there are
    firsts = prints.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "weak")).alias("p"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.select("hi", "lo", "p.*", "n"), "firsts")
    unique = firsts.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "weak")).alias("p")).select("doc_id", "p.*")
    near = near_links(probes(unique, samples), radius, block=block)
    shared = firsts.filter("n > 1").select("hi", "lo", F.col("doc_id").alias("b"))
    equal = prints.select("hi", "lo", F.col("doc_id").alias("a")).join(shared, ["hi", "lo"]).filter("a <> b").select("a", "b")
    return components(near.union(equal), then_release=(prints, firsts))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that another of their group stands for."""
    (key,) = unused(docs, "__id")
    lost = near_duplicates(docs, **params).select(F.col("doc_id").alias(key))
    return docs.join(lost, docs["doc_id"] == lost[key], "left_anti")


def op3_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
