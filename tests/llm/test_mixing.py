import hashlib
import math
from collections import Counter, defaultdict

from llm.tables import documents, ids, rows

from treeloom.llm import mixing as M


def brute(data, seed=M.SEED, epochs=1.0, weights=None):
    units = defaultdict(int)
    for i, text, source in data:
        units[source or "", i] += len(text or "")
    chars = Counter()
    for (s, _), n in units.items():
        chars[s] += n
    weight = {s: float(round(math.sqrt(n))) if weights is None else float(weights.get(s, 0)) for s, n in chars.items()}
    live = [s for s in chars if chars[s] > 0 and weight[s] > 0]
    total_w, total_c = sum(weight[s] for s in live), sum(chars[s] for s in live)
    out = {}
    for s in live:
        rate = math.floor(weight[s] / total_w * epochs * (total_c / chars[s]) * M.ONE)
        offset = int(hashlib.md5(f"{seed}:offset:{s}".encode()).hexdigest()[:8], 16)
        key = lambda i: int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        upto = offset
        for i in sorted((i for t, i in units if t == s), key=lambda i: (key(i), i is not None, i or 0)):
            n = (upto + rate >> 32) - (upto >> 32)
            upto += rate
            if n:
                out[i, s] = n
    return out


def sample(n=300):
    return [(i, "w" * (20 + i * 7 % 50), ["big", "big", "big", "mid", "tiny" if i % 10 == 4 else "mid"][i % 5]) for i in range(n)]


def test_against_brute_force_whatever_the_chunks(spark):
    data = sample()
    want = sorted((i, s, n) for (i, s), n in brute(data).items())
    for bits, parts in ((0, 1), (3, 7), (10, 3)):
        got = M.copies(documents(spark, data, clash=True).repartition(parts), chunk_bits=bits)
        assert sorted(map(tuple, got.collect())) == want


def test_sources_meet_their_targets(spark):
    data = sample(2000)
    weights = {"big": 0.2, "mid": 0.5, "tiny": 0.3}
    drawn = Counter()
    chars = {i: len(t) for i, t, _ in data}
    for r in M.copies(documents(spark, data), weights=weights, epochs=2.0).collect():
        drawn[r["source"]] += r["copies"] * chars[r["doc_id"]]
    total = sum(chars.values()) * 2
    assert all(abs(drawn[s] / total - w) < 0.02 for s, w in weights.items())


def test_expected_number_to_within_one(spark):
    data = [(i, "abcd", "a") for i in range(101)] + [(1000 + i, "abcd", "b") for i in range(37)]
    n = Counter()
    for r in M.copies(documents(spark, data), weights={"a": 1, "b": 1}).collect():
        n[r["source"]] += r["copies"]
    assert abs(n["a"] - 69) <= 1 and abs(n["b"] - 69) <= 1


def test_nulls_empties_and_unweighted_sources(spark):
    data = [(None, "abc", None), (1, "abc", None), (2, None, "void"), (3, "", "void"), (4, "abcdef", "x"), (5, None, "x")]
    want = sorted(((i, s, n) for (i, s), n in brute(data).items()), key=repr)
    assert sorted((tuple(r) for r in M.copies(documents(spark, data)).collect()), key=repr) == want
    only = M.copies(documents(spark, data), weights={"x": 1.0}).collect()
    assert only and {r["source"] for r in only} == {"x"}
    assert M.copies(documents(spark, data), weights={}).collect() == []


def test_repeated_rows_are_drawn_together_and_columns_stay(spark):
    data = [(1, "a" * 10, "s"), (1, "a" * 10, "s"), (2, "b" * 10, "s"), (3, "c" * 400, "t"), (None, "d", "t")]
    df = documents(spark, data, clash=True)
    want = brute(data)
    out = M.mix_documents(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    times = Counter((i, s) for i, _, s in data)
    assert got == {k: n * times[k] for k, n in want.items()}


def test_empty_table(spark):
    assert rows(M.copies(documents(spark, []))) == [] and ids(M.mix_documents(documents(spark, []))) == []


def test_long_texts_count_whole(spark):
    data = [(1, "x" * 3_000_000, "a"), (2, "y" * 10, "a"), (3, "z" * 1000, "b"), (4, "z" * 1000, "b")]
    want = sorted((i, s, n) for (i, s), n in brute(data).items())
    assert sorted(map(tuple, M.copies(documents(spark, data)).collect())) == want
