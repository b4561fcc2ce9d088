"""Registered queries on the driver's tables: oracles where SQL can say it, brute force elsewhere."""

import __spark_entry__ as entry_module
import duckdb
import numpy as np
import oracle
import pytest

from treeloom.llm import language_id, simhash, token_files, warc_zst
from treeloom.llm.queries import ORACLES, QUERIES
from treeloom.plans.staging import new_path

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_oracle(spark, name):
    oracle.same(spark, QUERIES[name], ORACLES[name], DIR)


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry_module.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_op3_recall_on_the_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' order by doc_id").fetchall()
    sums, n = simhash.bit_sums([t for _, t in rows], simhash._Words())
    bits, ids = (sums[n > 0] > 0).astype(np.float32), np.array([i for i, _ in rows])[n > 0]
    far = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    a, b = np.where(np.triu(far <= 20, 1))
    found = dict(map(tuple, QUERIES["op3_simhash_pivots"](spark, DIR).collect()))
    keep = lambda i: found.get(int(i), int(i))
    assert np.mean([keep(x) == keep(y) for x, y in zip(ids[a], ids[b])]) >= 0.9
    near, least = simhash.stars(np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]))
    assert set(found) <= set(near.tolist())


def test_op7_covers_every_document(spark):
    out = QUERIES["op7_token_arrow"](spark, DIR).toPandas()
    assert out["doc_id"].nunique() == 1000 and (out.groupby("doc_id")["seq"].max() + 1 == out.groupby("doc_id").size()).all()
    folder = new_path(spark, "check-tokens")
    placed = token_files.write(spark.read.parquet(f"{DIR}/documents.parquet"), folder).toPandas()
    first = placed.iloc[0]
    ids, mask = token_files.Reader(folder, first["file"]).sequence(first["batch"], first["row"])
    assert int(mask.sum()) == first["n_tokens"] and len(ids) == token_files.LENGTH


def test_op8_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language_id.fit(language_id.labelled_examples(docs, 600))
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    taken = got[got["language"] != "und"]
    assert (got["best"] == got["lang"]).mean() >= 0.98 and (taken["language"] == taken["lang"]).mean() >= 0.99 and len(taken) >= 0.95 * len(got)


def test_op9_round_trip_of_every_page(spark):
    folder = new_path(spark, "check-warc")
    pages = {r[0]: r for r in duckdb.sql(f"select page_id, url, html from '{DIR}/pages.parquet'").fetchall()}
    out = warc_zst.write(spark.read.parquet(f"{DIR}/pages.parquet"), folder).collect()
    assert len(out) == len(pages)
    for r in out:
        record = warc_zst.read_record(f"{folder.removeprefix('file:')}/{r['file']}", r["offset"], r["length"])
        assert record.endswith((pages[r["page_id"]][2] or "").encode() + b"\r\n\r\n") and f"WARC-Target-URI: {r['url']}".encode() in record


def test_op10_places_every_conversation_within_limits(spark):
    out = QUERIES["op10_vector_packing"](spark, DIR).toPandas()
    total = duckdb.sql(f"select count(distinct conv_id) from '{DIR}/conversations.parquet'").fetchall()[0][0]
    assert len(out) == out["conv_id"].nunique() == total
    sizes = out[~out["over"]].groupby("bin")[["tokens", "segments", "loss_tokens"]].sum()
    assert (sizes <= [8192, 32, 4096]).all().all()
