import random

from llm.tables import documents, rows

from treeloom.llm import license_scan as L


def blocks(text):
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        yield "line", k, 1, line
    start = None
    for k, line in enumerate([*lines, ""]):
        if L.tokens(line):
            start = k if start is None else start
        else:
            if start is not None and k - start > 1:
                yield "paragraph", start, k - start, " ".join(lines[start:k])
            start = None


def brute(data, templates, threshold):
    out = []
    for i, text in data:
        for kind, k, n, block in blocks(text):
            own = set(L.tokens(block))
            for name, words in templates.items():
                want = set(L.tokens(words))
                if want and len(own & want) >= L.needed(len(want), threshold):
                    out.append((i, kind, k, n, name, len(own & want), len(want)))
    return sorted(out, key=repr)


def test_equals_brute_force_at_many_thresholds(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{k}": " ".join(rng.sample(vocabulary, n)) for k, n in enumerate([1, 2, 3, 5, 8, 13])}
    data = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            base = rng.choice(list(templates.values())).split() if rng.random() < 0.6 else []
            kept = [w for w in base if rng.random() < 0.8]
            lines.append(" ".join(kept + rng.choices(vocabulary[:12] + ["other", "more", "--"], k=rng.randrange(0, 8))))
            if rng.random() < 0.3:
                lines.append(rng.choice(["", " * ", "#"]))
        data.append((i, "\n".join(lines)))
    df = documents(spark, data, clash=True)
    for threshold in (0.3, 0.5, 0.8, 1.0):
        want = brute(data, templates, threshold)
        assert rows(L.scan(df, templates, threshold)) == want and any(r[1] == "paragraph" for r in want)
        table = spark.createDataFrame(list(templates.items()) + [("null", None)], "template string, text string")
        assert rows(L.scan(df, table, threshold, batch_bytes=20)) == want  # several passes


def test_notices_wrapped_and_in_comments(spark):
    grant = L.TEMPLATES["mit-grant"].split()
    wrapped = "\n".join([" ".join(grant[:9]), " ".join(grant[9:])])
    comment = "\n".join(["/*", " * Copyright", " *", *(f" * {' '.join(grant[i : i + 5])}" for i in range(0, len(grant), 5)), " */"])
    data = [(1, "Intro.\n\n" + wrapped), (2, comment), (3, "All rights\nreserved."), (4, " ".join(grant[:9]) + "\n\n" + " ".join(grant[9:]))]
    got = {(r["doc_id"], r["block_kind"], r["block_no"], r["template"]) for r in L.scan(documents(spark, data)).collect()}
    assert got == {(1, "paragraph", 2, "mit-grant"), (2, "paragraph", 3, "mit-grant"), (3, "paragraph", 0, "all-rights-reserved")}


def test_templates_of_any_vocabulary(spark):
    whole = {f"license-{k}": " ".join(f"t{k}x{i}" for i in range(3000)) for k in range(4)}
    text = "\n".join(" ".join(f"t2x{i}" for i in range(at, at + 10)) for at in range(0, 2500, 10))
    assert rows(L.scan(documents(spark, [(7, text)]), whole)) == [(7, "paragraph", 0, 250, "license-2", 2500, 3000)]


def test_license_lines_whatever_the_case_and_surroundings(spark):
    data = [(1, "Some prose.\nLICENSED under the apache license, version 2.0!"), (2, "released under the MIT license. With more words after it"), (3, "the license of the work is a matter of version")]
    got = {(r["doc_id"], r["block_no"], r["template"]) for r in L.scan(documents(spark, data)).collect()}
    assert (1, 1, "apache-2.0") in got and (2, 0, "mit") in got and not any(i == 3 for i, _, _ in got)


def test_nulls_empties_repeats_and_long_texts(spark):
    text = L.TEMPLATES["all-rights-reserved"]
    long = "filler word " * 200_000 + "\n" + text
    data = [(1, None), (2, ""), (None, text), (4, text + "\n" + text), (4, text), (5, long), (6, "\n\n")]
    got = [(r["doc_id"], r["block_kind"], r["block_no"]) for r in L.scan(documents(spark, data, clash=True)).collect()]
    want = [(None, "line", 0), (4, "line", 0), (4, "line", 1), (4, "paragraph", 0), (4, "line", 0), (5, "line", 1), (5, "paragraph", 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_empty_templates(spark):
    assert rows(L.scan(documents(spark, []))) == []
    assert rows(L.scan(documents(spark, [(1, "x")]), {"none": "...", "void": ""})) == []
    assert rows(L.scan(documents(spark, [(1, "x")]), {})) == []
