import random

import numpy as np

from llm.tables import documents, ids, rows
from pyspark.sql import functions as F

from treeloom.llm import exact_dedup as D


def brute(data):
    first = {}
    for i, text in data:
        if i is not None:
            first[text] = min(first.get(text, i), i)
    return first


def test_against_brute_force_over_many_partitions(spark):
    rng = random.Random(4)
    data = [(i, f"text {rng.randrange(60)}") for i in range(500)]
    rng.shuffle(data)
    df = documents(spark, data).repartition(13)
    first = brute(data)
    want = sorted((i, first[t]) for i, t in data if first[t] != i)
    assert sorted(map(tuple, D.duplicates(df).collect())) == want
    assert sorted(map(tuple, D.duplicates(df, fan_in=2, rounds=4).collect())) == want
    assert ids(D.deduplicate(df)) == sorted(first.values())


def test_weak_digest_is_verified(spark):
    data = [(i, f"t{i % 7}") for i in range(70)]
    got = D.duplicates(documents(spark, data).repartition(5), digest=lambda c: F.length(c).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, i % 7) for i in range(7, 70))


def test_null_and_empty_texts_are_apart_and_null_ids_lose(spark):
    data = [(1, None), (2, None), (3, ""), (4, ""), (None, "a"), (5, "a"), (6, "a ")]
    got = rows(D.duplicates(documents(spark, data, clash=True)))
    assert got == sorted([(2, 1), (4, 3), (None, 5)], key=repr)
    out = D.deduplicate(documents(spark, data, clash=True))
    assert ids(out) == [1, 3, 5, 6]


def test_repeated_rows_become_one(spark):
    data = [(1, "a"), (1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "c"), (None, "z"), (None, "z")]
    df = documents(spark, data, clash=True)
    assert rows(D.duplicates(df)) == sorted([(1, 1), (1, 1), (2, 1), (None, None)], key=repr)
    out = D.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, "a"), (3, "b"), (3, "c"), (None, "z")], key=repr)


def test_long_texts_differ_in_their_last_character(spark):
    long = "x" * 2_000_000
    assert rows(D.duplicates(documents(spark, [(1, long + "a"), (2, long + "b"), (3, long + "a")]))) == [(3, 1)]


def test_partitions_grow_with_the_corpus():
    assert [D.shape_for(n) for n in (0, 64_000_000, 65_000_000)] == [(8, 2), (8, 2), (9, 2)]
    for n in (10**9, 5 * 10**10, 10**12):
        fan_in, rounds = D.shape_for(n)
        assert fan_in <= 32 and n / 1e6 <= fan_in**rounds < 2 * n / 1e6


def test_copies_of_one_text_stay_spread(spark):
    data = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    merged = D.tree_merge(D.entries(documents(spark, data).repartition(12)), 4, 2)
    held = merged.select(F.spark_partition_id().alias("p"), "copies").groupBy("p").count().collect()
    assert max(r["count"] for r in held) < 1200  # 2,000 rows of one text
    assert sorted(r["copies"] for r in merged.filter("copies > 1").collect()) == [2000]


def test_empty_table(spark):
    assert rows(D.duplicates(documents(spark, []))) == []
    assert rows(D.deduplicate(documents(spark, []))) == []


def test_no_second_shuffle_within_a_round(spark):
    plan = D.tree_merge(D.entries(documents(spark, [(1, "a")])), rounds=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Aggregate" not in plan


def test_runs_merge_into_a_sorted_run_of_smallest_ids():
    rng = np.random.RandomState(6)
    runs = [np.sort(rng.randint(0, 40, n)) for n in (30, 0, 25, 50)]
    digest = np.concatenate(runs)
    check = np.stack([digest % 3, digest * 0, rng.randint(0, 2, len(digest)), digest * 0], axis=1)
    ids, missing = rng.permutation(len(digest)), rng.rand(len(digest)) < 0.2
    order, begins = D.merge_runs(digest, check, np.zeros(len(digest), np.int64), ids, missing)
    kept = order[begins]
    best = {}
    for i in range(len(digest)):
        key = (digest[i], *check[i])
        best[key] = min(best.get(key, (True, 1 << 60)), (missing[i], ids[i]))
    assert (np.diff(digest[kept]) >= 0).all()
    assert {(digest[i], *check[i]): (missing[i], ids[i]) for i in kept} == best and len(kept) == len(best)
