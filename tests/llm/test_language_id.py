import math
import random

import numpy as np
from llm.tables import documents, rows

from treeloom.llm import language_id as L

SYLLABLES = {"aa": "ka mo ri ta shi no wa yu".split(), "bb": "sch ung ver ein keit ich".split(), "cc": "tion eau ère ou qui".split()}


def text(language, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(n=240, seed=0):
    rng = random.Random(seed)
    return [(text(k, rng, rng.randrange(8, 50)), k) for k in SYLLABLES for _ in range(n // 3)]


def test_held_out_accuracy_and_calibration(spark):
    model = L.train(labelled(), buckets=1 << 12)
    assert model.held_out_accuracy >= 0.97
    fresh = labelled(seed=9)
    df = documents(spark, [(i, t, "s", k) for i, (t, k) in enumerate(fresh)], clash=True)
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    right = [got[i]["best"] == k for i, (_, k) in enumerate(fresh)]
    taken = [got[i]["best"] == k for i, (_, k) in enumerate(fresh) if got[i]["language"] != "und"]
    assert sum(right) / len(right) >= 0.97 and sum(taken) / len(taken) >= 0.97 and len(taken) > 0.9 * len(fresh)
    mean = sum(r["confidence"] for r in got.values()) / len(got)
    assert abs(mean - sum(right) / len(right)) < 0.1


def test_table_of_scores_equals_embeddings_then_layer():
    grams = L.ngrams("Kamo rita, kamo!", 1 << 10)
    model = L.train(labelled(60), buckets=1 << 10)
    best, sure = model.confidences(["Kamo rita, kamo!"])
    p = L.softmax((model.scores[grams].mean(axis=0) + model.bias) / model.temperature)
    assert abs(p.max() - sure[0]) < 1e-4 and p.argmax() == best[0]


def test_ngrams_ignore_case_digits_and_punctuation():
    assert L.ngrams("Ab, cd 12", 1 << 10).tolist() == L.ngrams("ab cd", 1 << 10).tolist()
    assert len(L.ngrams(" ab ", 1 << 10)) == 3 + 2 + 1 and not len(L.ngrams("123 ...", 1 << 10))


def test_nulls_empties_repeats_and_long_texts(spark):
    model = L.train(labelled(90), buckets=1 << 12)
    rng = random.Random(5)
    long = text("bb", rng, 100_000)
    data = [(1, None), (2, ""), (3, "12 !?"), (None, text("aa", rng)), (4, long), (5, text("cc", rng)), (5, text("cc", rng))]
    got = L.identify(documents(spark, data, clash=True), model).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["language"] == "und" and by[i]["confidence"] == 0 for i in (1, 2, 3))
    assert by[None]["best"] == "aa" and by[4]["best"] == "bb"


def test_unlabelled_single_label_and_empty_tables(spark):
    bare = documents(spark, [(1, "some text", "s", None)])
    assert [r["language"] for r in L.label_corpus(bare).collect()] == ["und"]
    one = documents(spark, [(i, text("aa", random.Random(i)), "s", "aa") for i in range(20)])
    assert {(r["language"], r["confidence"]) for r in L.label_corpus(one).collect()} == {("aa", 1.0)}
    assert rows(L.label_corpus(documents(spark, []))) == []


def plain_ngrams(text, buckets):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    line = " " + " ".join(words) + " "
    out = []
    for order in L.ORDERS if words else ():
        for at in range(len(line) - order + 1):
            value = 0
            for c in line[at : at + order]:
                value = (value * 0x01000193 + ord(c)) % 2**32
            out.append(((value ^ order) * 0x9E3779B1 % 2**32 >> 8) % buckets)
    return out


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_scores_equal_a_plain_version(spark):
    buckets = 1 << 10
    model = L.train(labelled(90), buckets=buckets)
    rng = random.Random(3)
    texts = [text(k, rng, rng.randrange(1, 60)) for k in list(SYLLABLES) * 12] + ["", "Ka-mo 12 ri!", "x", None, "ß ÄÖ tion"]
    got = {r["doc_id"]: r for r in L.identify(documents(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        grams = plain_ngrams(t or "", buckets)
        if not grams:
            assert (got[i]["best"], got[i]["confidence"], got[i]["language"]) == ("und", 0.0, "und")
            continue
        mean = [sum(float(model.scores[g][k]) for g in grams) / len(grams) for k in range(3)]
        p = plain_softmax([(m + b) / model.temperature for m, b in zip(mean, model.bias)])
        best = p.index(max(p))
        assert got[i]["best"] == model.languages[best] and abs(got[i]["confidence"] - p[best]) < 1e-5
        assert got[i]["language"] == (model.languages[best] if round(p[best], 6) >= round(model.threshold, 6) else "und")


def test_training_equals_a_plain_version():
    data, buckets, width, epochs, rate = labelled(45), 64, 4, 2, 0.5
    model = L.train(data, buckets=buckets, width=width, epochs=epochs, rate=rate, seed=3)
    rng = np.random.RandomState(3)
    learn = [(plain_ngrams(t, buckets), sorted(SYLLABLES).index(k)) for i, (t, k) in enumerate(data) if i % 5 != 4]
    table = ((rng.rand(buckets, width) - 0.5) * (2 / width)).astype(np.float32).astype(float)
    weights, bias, done = np.zeros((width, 3)), np.zeros(3), 0
    for _ in range(epochs):
        for at in rng.permutation(len(learn)):
            grams, truth = learn[at]
            step = rate * (1 - done / (epochs * len(learn)))
            hidden = sum(table[g] for g in grams) / len(grams)
            error = np.array(plain_softmax(list(hidden @ weights + bias)))
            error[truth] -= 1
            back = weights @ error
            weights = weights - step * np.outer(hidden, error)
            bias = bias - step * error
            few = min(len(set(grams)), 200)
            for g in set(grams):
                table[g] -= step * few * grams.count(g) / len(grams) * back
            done += 1
    assert np.allclose(model.scores, table @ weights, atol=2e-3) and np.allclose(model.bias, bias, atol=1e-3)


def test_sample_is_bounded_and_stable(spark):
    df = documents(spark, [(i, f"text {i}", "s", "en") for i in range(3000)])
    plain = lambda rows: [[(g.tolist(), s.tolist(), k) for g, s, k in own] for own in rows]
    a, b = (plain(L.labelled_examples(df.repartition(n), 300)) for n in (7, 2))
    assert a == b and 200 < len(a) < 400


def test_examples_are_the_whole_text_and_one_line(spark):
    t = "ka mo ri\n\nta shi no"
    whole, line = L.examples_of(t, "aa", 1 << 10)
    assert sorted(set(plain_ngrams(t, 1 << 10))) == whole[0].tolist()
    assert line[0].tolist() in [sorted(set(plain_ngrams(x, 1 << 10))) for x in ("ka mo ri", "ta shi no")]
    assert len(L.examples_of("one line", "aa", 1 << 10)) == 1 and L.examples_of("12\n34", "aa", 1 << 10) == []
