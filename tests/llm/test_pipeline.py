import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
import pytest
from llm.tables import CLASH, documents
from llm.test_mixing import brute as brute_mix
from llm.test_packing import check
from llm.test_quality_rules import expected as expected_rates
from llm.test_simhash import brute as brute_near

from treeloom.llm import packing, tokenizing
from treeloom.llm import quality_rules as Q


def above(count, n, limit, variance):
    return count > n * limit and (count - n * limit) ** 2 > Q.Z2 * n * variance


def brute_rules(text):
    words = [w for w in re.split("[ \n\t\r\f]+", text or "") if w]
    text = text or ""
    n, lines = len(words), text.split("\n")
    letters = sum(c.isalpha() for c in text)
    return {
        "empty": n == 0,
        "symbols": above(sum(c in Q.SYMBOLS for c in text), n, 1 / 5, 1 / 5),
        "exclaim": above(text.count("!"), n, 1 / 4, 1 / 4),
        "shout": above(sum(c.isupper() for c in text), letters, 1 / 2, 1 / 4),
        "stutter": above(sum(a == b for a, b in zip(words, words[1:])), n, 1 / 5, 4 / 25),
        "lines": len(lines) >= 5 and len(set(lines)) * 10 < len(lines) * 7,
        "short": 0 < n < 3,
        "long_words": n >= 20 and len(text) > n * 16,
        "few_letters": n >= 5 and letters * 2 < len(text),
    }


def brute_quality(rows):
    """Kept (doc_id, text, source) by a plain reading of the rules."""
    broken = [brute_rules(t) for _, t, _ in rows]
    hosts = {}
    for (_, _, s), b in zip(rows, broken):
        failed, docs = hosts.get(s or "", (0, 0))
        hosts[s or ""] = (failed + any(b.values()), docs + 1)
    rate = {h: round(r, 6) for h, r in expected_rates(hosts).items()}
    kept = []
    for row, b in zip(rows, broken):
        allowed = 0 if rate[row[2] or ""] >= 0.4 else 1 if rate[row[2] or ""] >= 0.25 else 2
        if not any(b[r] for r in Q.HARD) and sum(b[r] for r in Q.SOFT) <= allowed:
            kept.append(row)
    return kept


def fixture():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for _ in range(120):
        rows.append([len(rows), prose(rng.randrange(60, 160)), rng.choice(["hot", "hot", "hot", "b", "c"])])
    for base in rows[:15]:  # exact copies, under other sources
        rows.append([len(rows), base[1], "c"])
    for base in rows[20:40]:  # near copies
        words = base[1].split()
        for at in rng.sample(range(len(words)), 2):
            words[at] = rng.choice(vocabulary)
        rows.append([len(rows), " ".join(words), "b"])
    for _ in range(10):
        rows.append([len(rows), " ".join(w + "###" for w in prose(30).split()), "b"])
        rows.append([len(rows), "so! so! loud! this! is!", "c"])
    rows += [list(rows[3]), list(rows[3]), list(rows[45])]  # repeated rows
    rows += [[500, None, "b"], [501, "", None], [502, "two words", "b"], [503, prose(6000), "hot"], [None, prose(90), "c"], [504, prose(70), None]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    documents(spark, fixture(), clash=True).repartition(3).write.parquet(f"{path}/documents.parquet")
    documents(spark, []).write.parquet(f"{path}/empty/documents.parquet")
    return str(path)


def test_stages_equal_a_brute_force_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, outputs = docs.columns, {}
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, folder), "test")
        outputs[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.first()["key"] == "x-key" and set(CLASH) <= set(docs.columns)
    got = {n: sorted(((r["doc_id"], r["text"], r["source"]) for r in outputs[n].collect()), key=repr) for n, _ in C.STAGES[:-1]}

    rows = brute_quality(fixture())
    assert got["quality rules"] == sorted(rows, key=repr)

    first = {}
    for row in rows:
        if row[1] not in first or (row[0] is not None and (first[row[1]][0] is None or row[0] < first[row[1]][0])):
            first[row[1]] = row
    rows = list(first.values())
    assert got["exact dedup"] == sorted(rows, key=repr)

    _, label = brute_near([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if r[0] is None or label[r[0]] == r[0]]
    assert got["simhash near-dedup"] == sorted(rows, key=repr)

    times = brute_mix([(i, t, s) for i, t, s in rows])
    rows = [r for r in rows for _ in range(times.get((r[0], r[2] or ""), 0))]
    assert got["mixing"] == sorted(rows, key=repr)

    packed = [r.asDict() for r in outputs["packing"].collect()]
    check(packed, packing.DOCUMENT_LIMITS)
    encode, want, tokens = tokenizing.load(tokenizing.DEFAULT_FILE)[0], Counter(), defaultdict(int)
    for i, t, _ in rows:
        want[i] += len(encode(t)) + 1
    for r in packed:
        tokens[r["doc_id"]] += r["tokens"]
    assert tokens == want


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    out = C.run(spark, folder)
    assert out.count() > 50 and "doc_id" in out.columns


def test_empty_documents(spark, folder):
    assert C.run(spark, f"{folder}/empty").count() == 0
