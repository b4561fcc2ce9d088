import base64

import numpy as np
import pytest
import sentencepiece
import tiktoken
from llm.tables import documents, prose, rows
from tokenizers import Tokenizer

from treeloom.llm import packing as P
from treeloom.llm import tokenizing

TURNS = "conv_id long, turn long, role string, text string, bin long, id string"


def slow_fill(sizes, limits):
    """The heuristic written plainly."""
    cap = [float(x) for x in limits]
    over = [i for i, s in enumerate(sizes) if any(x > c for x, c in zip(s, limits))]
    bins, left = [[i] for i in over], [i for i in range(len(sizes)) if i not in over]
    mean = [np.mean([sizes[i][d] / cap[d] for i in left]) if left else 0 for d in range(3)]
    weight = [m / sum(mean) for m in mean] if sum(mean) else [1, 1, 1]
    while left:
        room, own = list(limits), []
        while True:
            best, top = None, -1.0
            for i in left:
                if all(sizes[i][d] <= room[d] for d in range(3)):
                    score = sum(weight[d] * sizes[i][d] / cap[d] * room[d] / cap[d] for d in range(3))
                    if score > top + 1e-12:
                        best, top = i, score
            if best is None:
                break
            own.append(best)
            left.remove(best)
            room = [r - x for r, x in zip(room, sizes[best])]
        bins.append(own)
    return bins


def test_fill_equals_the_plain_heuristic():
    rng = np.random.RandomState(0)
    for n in (0, 1, 40, 150):
        sizes = np.stack([rng.randint(1, 900, n), rng.randint(1, 9, n), rng.randint(0, 500, n)], axis=1).astype(np.int64)
        limits = (2000, 12, 900)
        got = P.fill(sizes, limits)
        assert sorted(i for b in got for i in b) == list(range(n))
        assert all((sizes[b].sum(axis=0) <= limits).all() for b in got)
        assert got == slow_fill(sizes.tolist(), limits)


def placed(df):
    return [r.asDict() for r in df.collect()]


def check(out, limits):
    bins = {}
    for r in out:
        bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["tokens"]
        if own[0]["over"]:
            assert len(own) == 1
        else:
            assert all(sum(r[k] for r in own) <= m for k, m in zip(("tokens", "segments", "loss_tokens"), limits))
    return bins


def test_conversations_with_nulls_repeats_and_clashing_columns(spark):
    data = [(1, 0, "user", "hello there"), (1, 1, "assistant", "general answer"), (1, 1, "assistant", "general answer"), (2, 0, "user", None), (2, 1, None, ""), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame([(*r, 9, "x") for r in data], TURNS)
    count = lambda t: len(tokenizing.load(tokenizing.DEFAULT_FILE)[0](t)) + 1
    got = {r["id"]: r for r in placed(P.pack(P.conversation_examples(df)))}
    assert got[1]["tokens"] == count("hello there") + 2 * count("general answer") and got[1]["segments"] == 3
    assert got[1]["loss_tokens"] == 2 * count("general answer")
    assert (got[2]["tokens"], got[2]["segments"], got[2]["loss_tokens"]) == (2, 2, 0)
    assert got[None]["loss_tokens"] == count("lost")


def test_limits_hold_and_the_result_ignores_partitioning(spark):
    rng = np.random.RandomState(5)
    data = [(int(i), int(rng.randint(1, 500)), int(rng.randint(1, 6)), int(rng.randint(0, 200))) for i in range(700)] + [(9000, 5000, 1, 1), (9001, 1, 100, 1)]
    frame = spark.createDataFrame([(i, 0, i * 77, t, s, min(t, x)) for i, t, s, x in data], "id long, part int, deal long, tokens long, segments long, loss_tokens long")
    limits = (2048, 16, 700)
    one = placed(P.pack(frame.repartition(3), limits, group_size=100))
    two = placed(P.pack(frame.repartition(8), limits, group_size=100))
    key = lambda r: (r["bin"], r["slot"])
    assert sorted(one, key=key) == sorted(two, key=key)
    assert sorted(r["id"] for r in one) == sorted(d[0] for d in data)
    bins = check(one, limits)
    assert {r["id"] for r in one if r["over"]} == {9000, 9001}
    need = max(sum(d[k + 1] for d in data[:700]) / limits[k] for k in range(3))
    assert len(bins) <= need * 1.35 + 10


def test_long_documents_are_cut_and_none_of_their_tokens_lost(spark):
    data = [(1, prose(9000)), (2, "short one"), (2, "short one"), (3, None), (None, "")]
    df = documents(spark, data, clash=True)
    limits = (1024, 8, 1000)
    out = placed(P.pack(P.document_examples(df, limits), limits))
    check(out, limits)
    encode = tokenizing.load(tokenizing.DEFAULT_FILE)[0]
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert sum(r["tokens"] for r in by[1]) == len(encode(data[0][1])) + 1
    assert sorted(r["part"] for r in by[1]) == list(range(len(by[1]))) and all(r["tokens"] <= 1000 for r in by[1])
    assert len(by[2]) == 2 and by[3][0]["tokens"] == 1 and by[None][0]["tokens"] == 1


def test_empty_table(spark):
    assert rows(P.pack(P.document_examples(documents(spark, [])))) == []
    assert rows(P.pack(P.conversation_examples(spark.createDataFrame([], TURNS)))) == []


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(file):
    encode, size = tokenizing.load(f"/opt/tokenizers/{file}")
    ids = encode("Some text, and more.")
    assert ids and max(ids) < size - 1


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_long_texts_have_the_ids_of_the_library(file):
    path = f"/opt/tokenizers/{file}"
    if file.endswith("tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        whole = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    elif file.endswith("json"):
        model = Tokenizer.from_file(path)
        whole = lambda t: model.encode(t, add_special_tokens=False).ids
    else:
        whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
    rng = np.random.RandomState(1)
    letters = np.array(list("abcdefghij"))
    texts = [prose(110_000), "".join(letters[rng.randint(0, 10, 600_000)]), "one" + " " * 300_000 + "two " * 100_000 + "\n" * 200_000]
    assert all(len(t) > 500_000 for t in texts)
    for text in texts:
        assert tokenizing.load(path)[0](text) == whole(text)


def test_long_white_space_is_encoded_as_the_pattern_does():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizing.DEFAULT_FILE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.RandomState(2)
    pieces = ["a", "é", "1", "!", " ", "  ", "\n", "\t", "\u3000", "\x1c", "\xa0", "'s", "   "]
    for _ in range(3000):
        text = "".join(pieces[k] for k in rng.randint(0, len(pieces), rng.randint(1, 40)))
        assert tokenizing._around_spaces(text, own.encode_ordinary, own._encode_single_piece, 2) == own.encode_ordinary(text)
    assert len(tokenizing.load(tokenizing.DEFAULT_FILE)[0]("\n" * 3_000_000)) == 1_500_000


def test_a_very_long_conversation_has_a_bin_of_its_own(spark):
    data = [(1, 0, "user", "hello", 9, "x"), (2, 0, "assistant", "word " * 400_000, 9, "x"), (3, 0, "user", "hi", 9, "x")]
    got = {r["id"]: r for r in placed(P.pack(P.conversation_examples(spark.createDataFrame(data, TURNS))))}
    assert got[2]["over"] and got[2]["tokens"] == 400_002 and got[1]["bin"] == got[3]["bin"] != got[2]["bin"]


def test_bins_of_documents_are_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = placed(P.pack(P.document_examples(docs), P.DOCUMENT_LIMITS))
    bins = check(out, P.DOCUMENT_LIMITS)
    assert sum(r["tokens"] for r in out) / len(bins) > 0.95 * P.DOCUMENT_LIMITS[0]
