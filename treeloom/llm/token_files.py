"""Token ids in Arrow files that are read at random without copying.

Documents are tokenized whole and cut into sequences of ``length`` ids; the last
one of a document is padded and its mask says which ids are real.  Every task
writes one Arrow file (IPC file format, with its footer of batch offsets) of
batches of ``batch_rows`` sequences with the columns

* ``ids``: fixed-size list of ``length`` unsigned 16-bit integers (32-bit when the
  vocabulary needs it),
* ``mask``: fixed-size list of ``length`` bytes, 1 for a token, 0 for padding,
* ``doc_id`` and ``seq``.

A fixed-size list has no offsets: sequence *k* of a batch is the slice
``[k * length, (k + 1) * length)`` of one flat buffer, which :class:`Reader`
returns as a view of the memory-mapped file.

The result has one row for each sequence with the place where it lies, so it is
both manifest and index, and does not depend on how documents were split into
tasks except for the place.

Defined results: a null or empty text has one sequence without a token (all
padding), so no document is lost; every document ends with the end-of-text id,
which counts as a token unless the text is empty; a null id stays null; repeated
rows are written each; an empty table gives an empty result and no file; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import tokenizing
from treeloom.llm.shards import Shard, local_path
from treeloom.plans.staging import new_path, ship

LENGTH = 512
BATCH_ROWS = 1024


def cut(ids: list[int], length: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences and masks of one document, flat."""
    if ids:
        ids = [*ids, end]
    rows = max(1, -(-len(ids) // length))
    out, mask = np.full(rows * length, end, np.uint32), np.zeros(rows * length, np.uint8)
    out[: len(ids)] = ids
    mask[: len(ids)] = 1
    return out, mask


def _schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)),
            ("mask", pa.list_(pa.uint8(), length)),
            ("doc_id", pa.int64()),
            ("seq", pa.int32()),
        ]
    )


_OUT = "doc_id long, seq int, n_tokens int, checksum long, file string, batch int, row int"


def write(docs: DataFrame, folder: str, tokenizer: str = tokenizing.DEFAULT_FILE, length: int = LENGTH, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes the files when evaluated; one row for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = tokenizing.load(tokenizer)
        end, wide = size - 1, size > 1 << 16
        schema = _schema(length, wide)
        name = f"part-{TaskContext.get().partitionId():06d}.arrow"
        shard = writer = None
        flat: list[np.ndarray] = []
        masks: list[np.ndarray] = []
        owners: list[tuple[int | None, int]] = []
        batch_no = 0

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal flat, masks, owners, batch_no, shard, writer
            while len(owners) >= batch_rows or (everything and owners):
                ids, mask = np.concatenate(flat), np.concatenate(masks)
                n = min(batch_rows, len(owners))
                take, keep = ids[: n * length].astype(np.uint32 if wide else np.uint16), mask[: n * length]
                own, owners = owners[:n], owners[n:]
                flat, masks = [ids[n * length :]], [mask[n * length :]]
                if writer is None:
                    shard = Shard(folder, name)
                    writer = pa.ipc.new_file(shard.sink, schema)
                doc = pa.array([d for d, _ in own], pa.int64())
                seq = pa.array([s for _, s in own], pa.int32())
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (take, keep)]
                writer.write_batch(pa.RecordBatch.from_arrays([*lists, doc, seq], schema=schema))
                real = keep.reshape(n, length)
                grid = take.reshape(n, length).astype(np.int64) * real
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        seq,
                        pa.array(real.sum(axis=1, dtype=np.int32)),
                        pa.array((grid * np.arange(1, length + 1)).sum(axis=1)),
                        pa.array([name] * n),
                        pa.array(np.full(n, batch_no, np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                    ],
                    ["doc_id", "seq", "n_tokens", "checksum", "file", "batch", "row"],
                )
                batch_no += 1

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids, mask = cut(encode(text) if text else [], length, end)
                    flat.append(ids)
                    masks.append(mask)
                    owners += [(doc_id, s) for s in range(len(ids) // length)]
                    if len(owners) >= 2 * batch_rows:
                        yield from flush(False)
            yield from flush(True)
            if writer is not None:
                writer.close()
                shard.commit()
        except BaseException:
            if shard is not None:
                shard.abort()
            raise

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


class Reader:
    """Random access to one file; arrays are views of the memory map."""

    def __init__(self, folder: str, name: str) -> None:
        self.source = pa.memory_map(f"{local_path(folder)}/{name}")
        self.file = pa.ipc.open_file(self.source)

    def __len__(self) -> int:
        return self.file.num_record_batches

    def batch(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids and masks of a batch, as two matrices."""
        columns = self.file.get_batch(number)
        ids, mask = columns.column("ids"), columns.column("mask")
        length = ids.type.list_size
        return tuple(x.flatten().to_numpy(zero_copy_only=True).reshape(-1, length) for x in (ids, mask))

    def sequence(self, batch: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(batch)
        return ids[row], mask[row]


def op7_token_arrow(spark, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "tokens"))
