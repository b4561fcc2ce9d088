import random
import tracemalloc

import numpy as np
import pandas as pd
from llm.tables import documents, ids, prose, rows

from treeloom.llm import simhash as S


def groups(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute(data, radius=20):
    texts = [(i, t) for i, t in data if i is not None]
    sums, n = S.bit_sums([t for _, t in texts], S._Words())
    bits = sums > 0
    pairs = [
        (texts[a][0], texts[b][0])
        for a in range(len(texts))
        for b in range(a)
        if n[a] and n[b] and (bits[a] != bits[b]).sum() <= radius
    ]
    return pairs, groups(pairs, [i for i, _ in texts])


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    data = []
    for g in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            data.append((len(data), " ".join(own)))
    return data


def test_recall_against_brute_force(spark):
    data = corpus()
    pairs, label = brute(data)
    found = dict(map(tuple, S.near_duplicates(documents(spark, data, clash=True).repartition(5)).collect()))
    assert len(pairs) > 30
    assert np.mean([found.get(a, a) == found.get(b, b) for a, b in pairs]) >= 0.9
    for a, keep in found.items():  # nothing is linked that isn't near, or connected through what is
        assert label[a] == label[keep] and keep < a


def test_large_groups_and_chains_have_one_keeper(spark):
    rng = random.Random(1)
    words = prose(150).split()
    data = []
    for i in range(S.SMALL * 3):
        own = list(words)
        own[rng.randrange(len(own))] = f"new{i}"
        data.append((i + 5, " ".join(own)))
    found = dict(map(tuple, S.near_duplicates(documents(spark, data)).collect()))
    assert found == {i + 5: 5 for i in range(1, S.SMALL * 3)}


def test_pivots_never_discard_a_near_pair():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 2, (300, S.BITS))
    other = base.copy()
    for row in other:
        row[rng.choice(S.BITS, rng.randint(0, 21), replace=False)] ^= 1
    packed = S.pack(np.concatenate([base, other]))
    table = S.pivot_table(packed[:, 0].copy(), packed[:, 1].copy(), S.references())
    i, j = np.arange(300), np.arange(300) + 300
    assert not S._apart(table, i, j, 20).any()
    far = S._apart(table, i, np.roll(i, 1), 20)
    assert far.mean() > 0.5  # most random pairs are discarded
    assert (S.unpack(packed[:, 0].copy(), packed[:, 1].copy())[:300] == base).all()


def test_pivot_rows_are_made_in_little_more_memory_than_they_fill():
    rng = np.random.RandomState(5)
    hi, lo = rng.randint(-(2**62), 2**62, (2, 50_000))
    tracemalloc.start()
    table = S.pivot_table(hi, lo, S.references())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * table.nbytes
    at = np.arange(0, 50_000, 4999)
    assert (table[at] == S.pivot_table(hi[at], lo[at], S.references())).all()


def test_links_in_small_and_large_buckets_agree():
    rng = np.random.RandomState(3)
    centers = rng.randint(0, 2, (6, S.BITS))
    bits = np.concatenate([np.abs(c - (rng.rand(12, S.BITS) < 0.04)) for c in centers]).astype(int)
    packed = S.pack(bits)
    ids_, hi, lo = np.arange(72), packed[:, 0].copy(), packed[:, 1].copy()
    brute_pairs = [(a, b) for a in range(72) for b in range(a) if (bits[a] != bits[b]).sum() <= 20]
    want = groups(brute_pairs, range(72))
    for bucket in (np.zeros(72, np.int64),):
        a, b, stats = S.links(bucket, ids_, hi, lo, S.references(), 20)
        assert groups(list(zip(a, b)), range(72)) == want
        assert stats["pairs"] >= stats["survivors"] >= stats["near"]
    half = np.repeat([0, 1, 2], 24)
    a, b, _ = S.links(half, ids_, hi, lo, S.references(), 20)
    assert groups(list(zip(a, b)), range(72)) == groups([(x, y) for x, y in brute_pairs if half[x] == half[y]], range(72))


def test_nulls_empties_repeats_and_long_texts(spark):
    long = prose(120_000)
    data = [(1, None), (2, ""), (3, " ... !!"), (None, prose(80)), (4, prose(80)), (5, prose(80)), (5, prose(80)), (6, long), (7, long + " end"), (None, None)]
    df = documents(spark, data, clash=True)
    assert rows(S.near_duplicates(df)) == [(5, 4), (7, 6)]
    out = S.keep_one(df)
    assert out.columns == df.columns and ids(out) == [None, None, 1, 2, 3, 4, 6]


def test_keys_grow_with_the_corpus():
    assert S.sizing(0) == S.sizing(1 << 28) == (14, 24) and S.sizing(1 << 36) == (55, 32)
    assert [S.sizing(1 << n)[1] for n in (29, 34)] == [25, 30]
    for n in range(28, 40):  # a pair at the radius meets in as many tables at every size
        tables, bits = S.sizing(1 << n)
        assert tables * (1 - 20 / S.BITS) ** (bits - 24) >= 14


def test_large_buckets_are_cut_into_blocks_and_lose_nothing(spark):
    rng = np.random.RandomState(4)
    n, block = 3000, 128
    bits = rng.randint(0, 2, (n, S.BITS))
    for k in range(400):  # chains of near members, spread over all blocks
        a, b = rng.choice(n, 2, replace=False)
        bits[b] = bits[a]
        bits[b, rng.choice(S.BITS, rng.randint(0, 19), replace=False)] ^= 1
    packed = S.pack(bits)
    bucket = np.where(np.arange(n) < 2700, 5, rng.randint(6, 60, n))
    frame = pd.DataFrame({"bucket": bucket, "doc_id": np.arange(n), "hi": packed[:, 0], "lo": packed[:, 1]})
    far = bits.astype(np.float32)
    far = far @ (1 - far.T) + (1 - far) @ far.T
    pairs = [(a, b) for a, b in zip(*np.where(np.triu(far <= 20, 1))) if bucket[a] == bucket[b]]
    entries = spark.createDataFrame(frame).repartition(5)
    for chunk in (300, 100_000):
        got = S.near_links(entries, 20, chunk, block)
        assert got.rdd.getNumPartitions() > 1
        assert groups([tuple(r) for r in got.collect()], range(n)) == groups(pairs, range(n))


def test_hot_fingerprints_and_hubs_are_combined_before_the_shuffle(spark):
    data = [(i, "same words in every one of them") for i in range(300)] + [(1000 + i, prose(60, i)) for i in range(20)]
    found = dict(map(tuple, S.near_duplicates(documents(spark, data)).collect()))
    assert {i: k for i, k in found.items() if i < 1000} == {i: 0 for i in range(1, 300)}
    star = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(i, i - 1) for i in range(4000, 4010)], "a long, b long")
    assert rows(S.components(star)) == sorted([(i, 0) for i in range(1, 3000)] + [(i, 3999) for i in range(4000, 4010)], key=repr)


def test_empty_table(spark):
    assert rows(S.near_duplicates(documents(spark, []))) == []
    assert rows(S.keep_one(documents(spark, []))) == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert rows(S.components(edges)) == sorted([(i, 1) for i in range(2, 41)] + [(101, 100)], key=repr)
