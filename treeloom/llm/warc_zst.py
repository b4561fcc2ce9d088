"""Web archive writer with a Zstandard dictionary in front of every file.

Pages become WARC/1.1 response records.  Each task trains a dictionary on all
records of its shard, writes it as a leading skippable frame (magic
``0x184D2A5D``, the dictionary itself compressed), then a ``warcinfo`` record and
the page records, every one in a frame of its own that was compressed with the
dictionary.  A reader that knows a record's offset and length decodes that frame
alone.

The result is the index: one row for each page with file, offset and length of
its frame, sizes and the SHA-1 of its payload in base 32, as archive indexes use.
Pages are dealt to shards of about ``shard_mb`` by the bytes counted over the whole
table, by a hash of id and address, so shards are the same whatever the input's
partitioning.  A task makes one shard, or several, one after another, where there
are more than ``TASKS`` of them.

Defined results: a null page body is an empty payload and a null address an empty
target; a null id is written as ``null``; repeated rows are written each, with one
record id, in an order by id, address and payload that leaves no tie to chance;
payloads are archived whole, whatever their length; records of a shard that are too
few or too unlike for the trainer are its dictionary themselves, as raw content; an
empty table gives an empty index and no file; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.shards import Shard
from treeloom.plans.staging import new_path, ship

MAGIC = 0x184D2A5D
#: Partitions of the shuffle that deals pages to shards.
TASKS = 16_384
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, key: str, target: str, date: str, content_type: str, payload: bytes, http: bool) -> tuple[bytes, str]:
    """A WARC record and the digest of its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() if http else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}:{target}')}>", f"WARC-Date: {date}"]
    if target:
        lines.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {content_type}", f"Content-Length: {len(head) + len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + head + payload + b"\r\n\r\n", digest


def train(samples: list[bytes], size: int):
    """A dictionary over all samples.

    Samples that Zstandard's trainer has too little of (it wants several, with
    something in common) are a dictionary themselves, as raw content: the last
    ``size`` bytes of them.
    """
    import zstandard

    try:
        # fixed parameters of the fast cover trainer, so that its result is reproducible; accel=1 reads all positions of all samples
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 16)), samples, k=200, d=8, f=18, accel=1, steps=1, split_point=1.0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(content)) + content


_OUT = "page_id long, url string, file string, offset long, length long, record_bytes long, payload_bytes long, payload_sha1 string"


def write(pages: DataFrame, folder: str, shard_mb: int = 16, dictionary_bytes: int = 112_640, level: int = 6, date: str = DATE) -> DataFrame:
    """Writes the archive when evaluated; one row for each page."""

    def shard_of(number: int, rows: pa.Table) -> pa.RecordBatch:
        import zstandard

        ids, urls, bodies = (rows.column(i).to_pylist() for i in (1, 2, 3))
        made = []
        for key, url, html in zip(ids, urls, bodies):
            payload = (html or "").encode("utf-8", "replace")
            made.append((*record("response", "null" if key is None else str(key), url or "", date, "application/http; msgtype=response", payload, True), len(payload)))
        dictionary = train([m[0] for m in made], dictionary_bytes)
        name = f"shard-{number:06d}.warc.zst"
        shard = Shard(folder, name)
        try:
            own = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
            front = skippable(zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes()))
            info, _ = record("warcinfo", f"{name}:{len(made)}", "", date, "application/warc-fields", b"format: WARC File Format 1.1\r\n", False)
            start = front + own.compress(info)
            shard.sink.write(start)
            at, offsets, lengths = len(start), [], []
            for content, _, _ in made:
                frame = own.compress(content)
                shard.sink.write(frame)
                offsets.append(at)
                lengths.append(len(frame))
                at += len(frame)
            shard.commit()
        except BaseException:
            shard.abort()
            raise
        n = len(made)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(urls, pa.string()),
                pa.array([name] * n),
                pa.array(offsets, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([len(m[0]) for m in made], pa.int64()),
                pa.array([m[2] for m in made], pa.int64()),
                pa.array([m[1] for m in made]),
            ],
            ["page_id", "url", "file", "offset", "length", "record_bytes", "payload_bytes", "payload_sha1"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            at = 0
            while at < len(numbers):
                number = int(numbers[at])
                end = at + int((numbers[at:] == number).sum())
                if held and number != current:
                    yield shard_of(current, pa.Table.from_batches(held))
                    held = []
                current = number
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield shard_of(current, pa.Table.from_batches(held))

    ship(pages.sparkSession)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    total = narrow.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 400)).first()[0] or 0
    shards = max(1, math.ceil(total / (shard_mb * 1_000_000)))
    dealt = narrow.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(shards)).cast("long").alias("shard"), "page_id", "url", "html")
    tasks = min(shards, TASKS)
    placed = dealt.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "page_id", "url", F.xxhash64("html"))
    return placed.mapInArrow(run, _OUT)


def read_dictionary(stream: io.BufferedIOBase):
    """The dictionary in a file's leading frame."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(size)))


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record, decoded from its own frame."""
    import zstandard

    with open(path, "rb") as stream:
        dictionary = read_dictionary(stream)
        stream.seek(offset)
        return zstandard.ZstdDecompressor(dict_data=dictionary).decompress(stream.read(length))


def op9_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
