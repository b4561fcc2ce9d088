import base64
import hashlib
import io
import uuid

import zstandard
from llm.tables import rows

from treeloom.llm import warc_zst as W
from treeloom.plans.staging import new_path

SCHEMA = "page_id long, url string, html string, shard string, file string"


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def html(i, n=40):
    return "<html><head><title>Page</title></head><body>" + "".join(f"<p class='item'>Paragraph {i * j} of the page</p>" for j in range(n)) + "</body></html>"


def path(folder, name):
    return f"{folder.removeprefix('file:')}/{name}".replace("//", "/")


def test_every_record_decodes_alone(spark):
    data = [(i, f"http://example.com/{i}", html(i)) for i in range(300)] + [(900, None, None), (None, "http://example.com/n", ""), (901, "http://example.com/r", "same"), (901, "http://example.com/r", "same")]
    folder = new_path(spark, "test-warc")
    out = W.write(pages(spark, data).repartition(5), folder, shard_mb=0.3).collect()
    assert len(out) == len(data) and len({r["file"] for r in out}) > 1
    bodies = {}
    for i, url, body in data:
        bodies.setdefault((i, url), (body or "").encode())
    for r in out:
        content = W.read_record(path(folder, r["file"]), r["offset"], r["length"])
        head, _, rest = content.partition(b"\r\n\r\n")
        http, _, body = rest.partition(b"\r\n\r\n")
        body = body[: r["payload_bytes"]]
        assert content.startswith(b"WARC/1.1\r\nWARC-Type: response") and content.endswith(b"\r\n\r\n") and len(content) == r["record_bytes"]
        assert body == bodies[r["page_id"], r["url"]]
        assert r["payload_sha1"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
        assert length == len(rest) - 4


def test_file_layout_is_a_dictionary_frame_and_consecutive_records(spark):
    folder = new_path(spark, "test-layout")
    out = sorted(W.write(pages(spark, [(i, f"u{i}", html(i)) for i in range(60)]), folder).collect(), key=lambda r: r["offset"])
    raw = open(path(folder, out[0]["file"]), "rb").read()
    stream = io.BytesIO(raw)
    dictionary = W.read_dictionary(stream)
    assert dictionary is not None and raw[:4] == b"\x5d\x2a\x4d\x18"
    info = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(raw[stream.tell() : out[0]["offset"]])
    assert b"WARC-Type: warcinfo" in info
    for a, b in zip(out, out[1:]):
        assert a["offset"] + a["length"] == b["offset"]
    assert out[-1]["offset"] + out[-1]["length"] == len(raw)
    plain = sum(len(zstandard.ZstdCompressor(level=6).compress(W.read_record(path(folder, r["file"]), r["offset"], r["length"]))) for r in out)
    assert sum(r["length"] for r in out) < plain


def test_shards_do_not_depend_on_partitions(spark):
    data = [(i, f"u{i}", html(i)) for i in range(80)]
    index = [sorted(map(tuple, W.write(pages(spark, data).repartition(n), new_path(spark, "test-same"), shard_mb=0.05).collect())) for n in (1, 6)]
    assert index[0] == index[1]


def test_long_pages_few_records_and_empty_table(spark):
    long = html(3, 60_000)
    folder = new_path(spark, "test-few")
    out = W.write(pages(spark, [(1, "u\r\nX: y", long)]), folder).collect()
    content = W.read_record(path(folder, out[0]["file"]), out[0]["offset"], out[0]["length"])
    assert long.encode() in content and b"u%0D%0AX: y" in content
    assert rows(W.write(pages(spark, []), new_path(spark, "test-void"))) == []


def test_training_reads_all_positions_of_all_samples():
    samples = [html(i).encode() + hashlib.sha512(str(i).encode()).hexdigest().encode() * 3 for i in range(200)]
    made = lambda accel: zstandard.train_dictionary(8192, samples, k=200, d=8, f=18, accel=accel, steps=1, split_point=1.0).as_bytes()
    assert W.train(samples, 8192).as_bytes() == made(1) != made(4)


def test_few_records_have_a_dictionary_too(spark):
    for n in (1, 2, 7):
        folder = new_path(spark, "test-raw")
        data = [(i, f"u{i}", html(i)) for i in range(n)]
        out = W.write(pages(spark, data), folder).collect()
        with open(path(folder, out[0]["file"]), "rb") as stream:
            dictionary = W.read_dictionary(stream)
        assert len(dictionary.as_bytes()) > 100
        for r in out:
            assert data[r["page_id"]][2].encode() in W.read_record(path(folder, r["file"]), r["offset"], r["length"])
            with open(path(folder, r["file"]), "rb") as stream:
                stream.seek(r["offset"])
                frame = stream.read(r["length"])
            assert len(frame) < len(zstandard.ZstdCompressor(level=6).compress(W.read_record(path(folder, r["file"]), r["offset"], r["length"])))


def plain_record(page_id, url, body):
    payload = (body or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"response:{'null' if page_id is None else page_id}:{url or ''}")
    target = [f"WARC-Target-URI: {url}"] if url else []
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", *target, f"WARC-Payload-Digest: sha1:{digest}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n", digest


def test_index_and_bytes_equal_a_plain_version_with_ties(spark):
    data = [(i % 30, f"u{i % 30}", html(i % 3)) for i in range(90)] + [(None, None, None), (None, None, None), (5, None, "x"), (5, None, "a")]
    folder = new_path(spark, "test-plain")
    out = W.write(pages(spark, data).repartition(4), folder).collect()
    assert len(out) == len(data) and {r["file"] for r in out} == {"shard-000000.warc.zst"}
    made = [(key, url, *plain_record(key, url, body), len((body or "").encode())) for key, url, body in data]
    assert sorted(((r["page_id"], r["url"], r["payload_sha1"], r["record_bytes"], r["payload_bytes"]) for r in out), key=repr) == sorted(((k, u, d, len(c), n) for k, u, c, d, n in made), key=repr)
    got = [W.read_record(path(folder, r["file"]), r["offset"], r["length"]) for r in sorted(out, key=lambda r: r["offset"])]
    assert sorted(got) == sorted(c for _, _, c, _, _ in made)
    order = [(r["page_id"] is not None, r["page_id"] or 0, r["url"] or "") for r in sorted(out, key=lambda r: r["offset"])]
    assert order == sorted(order)
