import os

import numpy as np
import pyarrow as pa
from llm.tables import documents, prose, rows

from treeloom.llm import token_files as T
from treeloom.llm import tokenizing
from treeloom.plans.staging import new_path


def test_round_trip_and_zero_copy(spark):
    data = [(i, prose(20 + i * 13, i)) for i in range(40)] + [(90, None), (91, ""), (None, "null id"), (92, "twice"), (92, "twice")]
    folder = new_path(spark, "test-tokens")
    out = [r.asDict() for r in T.write(documents(spark, data, clash=True).repartition(3), folder, length=64, batch_rows=16).collect()]
    encode, size = tokenizing.load(tokenizing.DEFAULT_FILE)
    end, by = size - 1, {}
    for r in out:
        ids, mask = T.Reader(folder, r["file"]).sequence(r["batch"], r["row"])
        assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16
        assert int(mask.sum()) == r["n_tokens"] and (ids[mask == 0] == end).all()
        assert r["checksum"] == int((ids.astype(np.int64) * mask * np.arange(1, 65)).sum())
        by.setdefault(r["doc_id"], []).append((r["seq"], ids[mask == 1].tolist()))
    for doc_id, text in data:
        got = sorted(by[doc_id])
        copies = 2 if doc_id == 92 else 1
        want = [*encode(text), end] if text else []
        assert sum((s for _, s in got), []) == (want * copies if copies == 1 else want + want)
        assert len(got) == copies * max(1, -(-len(want) // 64))


def test_arrays_are_views_of_the_mapped_file(spark):
    folder = new_path(spark, "test-view")
    out = T.write(documents(spark, [(1, prose(500))]), folder, length=32).collect()
    before = pa.total_allocated_bytes()
    ids, mask = T.Reader(folder, out[0]["file"]).batch(0)
    assert not ids.flags.owndata and not ids.flags.writeable and ids.base is not None
    assert pa.total_allocated_bytes() - before < ids.nbytes
    kept = pa.ipc.open_file(pa.memory_map(f"{folder.removeprefix('file:')}/{out[0]['file']}"))
    assert pa.types.is_fixed_size_list(kept.schema.field("ids").type)


def test_long_texts_and_wide_vocabularies(spark):
    text = prose(150_000)
    folder = new_path(spark, "test-long")
    out = T.write(documents(spark, [(1, text)]), folder, length=512).collect()
    assert sum(r["n_tokens"] for r in out) == len(tokenizing.load(tokenizing.DEFAULT_FILE)[0](text)) + 1
    assert T._schema(4, True).field("ids").type.value_type == pa.uint32()


def test_empty_table_writes_no_file(spark):
    folder = new_path(spark, "test-none")
    assert rows(T.write(documents(spark, []), folder)) == []
    assert not os.path.exists(folder.removeprefix("file:"))


def test_index_equals_a_plain_version(spark):
    data = [(i, prose(3 + i * 29, i)) for i in range(30)] + [(70, None), (71, ""), (None, "x"), (72, "tie"), (72, "tie"), (72, "tie")]
    encode, size = tokenizing.load(tokenizing.DEFAULT_FILE)
    want = []
    for doc_id, text in data:
        ids = encode(text) + [size - 1] if text else []
        for seq in range(max(1, (len(ids) + 15) // 16)):
            own = ids[seq * 16 : seq * 16 + 16]
            want.append((doc_id, seq, len(own), sum((k + 1) * t for k, t in enumerate(own))))
    out = T.write(documents(spark, data, clash=True).repartition(3), new_path(spark, "test-index"), length=16, batch_rows=8).collect()
    assert sorted(((r["doc_id"], r["seq"], r["n_tokens"], r["checksum"]) for r in out), key=repr) == sorted(want, key=repr)
    places = [(r["file"], r["batch"], r["row"]) for r in out]
    assert len(set(places)) == len(out) and all(r["row"] < 8 for r in out)
    for file in {f for f, _, _ in places}:  # batches are full but for the last
        batches = [b for f, b, _ in places if f == file]
        assert [batches.count(b) for b in range(max(batches))] == [8] * max(batches)
