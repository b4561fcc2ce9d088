"""License scan: exact set-similarity join of templates with text blocks.

A block is a line, or a paragraph: a run of two lines or more of which each has a
letter or digit, so a notice is found wrapped or in a comment too.  The token set
of every block is compared with that of every template, and all pairs with
``|template & block| >= threshold * |template|`` are found, exactly, by the
prefix-filter family of joins (Xiao et al., PPJoin):

* tokens are ordered by their frequency over all blocks of the corpus, rarest
  first (ties by the token);
* *prefix filter*: a pair that reaches the overlap ``o`` shares a token among the
  first ``|template| - o + 1`` of the template and the first ``|block| - o + 1``
  of the block, so candidates come from an index of the templates' prefixes;
* *length filter*: a block with fewer than ``o`` tokens can't qualify;
* *positional filter*: if the first shared token is at ``i`` in the template and
  ``j`` in the block, the overlap is at most the lesser of what begins there;
* survivors are verified by the size of the intersection.

Tokens outside all templates can't add to an overlap, so blocks are reduced to
the template vocabulary when they are read, and those with fewer known tokens
than the least overlap of any template are left out of the join and its counts
(any common order of the tokens gives the same pairs).  The text is read once; what
is stored and joined after it are small arrays of token numbers.

Templates are a dict or a table ``(template, text)`` of any size: they are taken in
batches of at most ``BATCH_BYTES`` of text (one at least), each a pass with its own
vocabulary and index, which are what is sent to the executors.

Defined results: null and empty texts have no block; blocks are numbered by their
first line, from 0; tokens are maximal runs of ASCII letters and digits, in lower
case; a repeated token counts once; lines and paragraphs are read whole, whatever
their length; rows that repeat an id are reported each; templates without a token
(null too) are ignored, and templates of one name are each reported; all templates
that a block ties with are reported; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.staging import materialize, ship

#: Template text of one pass.
BATCH_BYTES = 16_000_000
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_TOKEN = re.compile(r"[A-Za-z0-9]+")


def tokens(text: str) -> list[str]:
    return sorted({t.lower() for t in _TOKEN.findall(text)})


def needed(size: int, threshold: float) -> int:
    """Smallest overlap that reaches the threshold."""
    return max(1, math.ceil(round(threshold * size, 9)))


def batches_of(templates: dict[str, str] | DataFrame | None, limit: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Names and token sets of templates, in batches of at most ``limit`` bytes of text."""
    if isinstance(templates, DataFrame):
        rows = ((r["template"], r["text"]) for r in templates.select("template", "text").toLocalIterator())
    else:
        rows = iter((TEMPLATES if templates is None else templates).items())
    held: list[tuple[str, list[str]]] = []
    size = 0
    for name, text in rows:
        if not text or not (own := tokens(text)):
            continue
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((name, own))
        size += len(text)
    if held:
        yield held


def blocks_of(text: str, vocabulary: dict[str, int], least: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """Kind, first line, number of lines and known tokens of all blocks that have at least ``least`` of those."""
    known = vocabulary.keys()
    lower = lambda part: set(" ".join(_TOKEN.findall(part)).lower().split(" "))
    if len(known & lower(text)) < least:
        return
    run: set[str] = set()
    first = lines = 0
    for number, line in enumerate([*text.split("\n"), ""]):
        words = lower(line)
        if words != {""}:
            own = known & words
            if len(own) >= least:
                yield "line", number, 1, [vocabulary[t] for t in own]
            first, lines = (first, lines + 1) if lines else (number, 1)
            run |= own
        else:
            if lines > 1 and len(run) >= least:
                yield "paragraph", first, lines, [vocabulary[t] for t in run]
            run, lines = set(), 0


class Index:
    """Prefixes of templates under an order of tokens; all of a batch, so bounded like it."""

    def __init__(self, sets: list[tuple[str, list[int]]], rank: list[int], threshold: float) -> None:
        self.rank = rank
        self.names = [name for name, _ in sets]
        self.sets = [frozenset(rank[t] for t in own) for _, own in sets]
        self.needs = [needed(len(own), threshold) for own in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.sets):
            for i, token in enumerate(sorted(own)[: len(own) - self.needs[k] + 1]):
                self.prefixes.setdefault(token, []).append((k, i))

    def matches(self, known: list[int]) -> Iterator[tuple[int, int]]:
        """Numbers of the templates that a block reaches, with the overlap."""
        block = sorted(self.rank[t] for t in known)
        whole, met = set(block), set()
        for j, token in enumerate(block):
            for k, i in self.prefixes.get(token, ()):
                if k in met:
                    continue
                # in a common order, this is the first token that the two share
                met.add(k)
                need = self.needs[k]
                if len(block) >= need and min(len(self.sets[k]) - i, len(block) - j) >= need:
                    overlap = len(whole & self.sets[k])
                    if overlap >= need:
                        yield k, overlap


_MATCH = "block_kind string, block_no int, block_lines int, template string, overlap int, template_tokens int"


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, threshold: float = 0.8, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, block_kind, block_no, block_lines, template, overlap, template_tokens)`` of all qualifying pairs."""
    found = None
    for sets in batches_of(templates, batch_bytes):
        part = _scan_batch(docs.select("doc_id", "text"), sets, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {_MATCH}")
    return found


def _scan_batch(docs: DataFrame, sets: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = sorted({t for _, own in sets for t in own})
    least = min(needed(len(own), threshold) for _, own in sets)
    vocabulary = context.broadcast({t: k for k, t in enumerate(words)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            at, kinds, firsts, lines, known = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for block in blocks_of(text, numbers, least) if text else ():
                    at.append(row)
                    for column, value in zip((kinds, firsts, lines, known), block):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(kinds, pa.string()),
                    pa.array(firsts, pa.int32()),
                    pa.array(lines, pa.int32()),
                    pa.array(known, pa.list_(pa.int32())),
                ],
                ["doc_id", "block_kind", "block_no", "block_lines", "tokens"],
            )

    ship(docs.sparkSession)
    blocks = materialize(docs.mapInArrow(read, f"doc_id {kind}, block_kind string, block_no int, block_lines int, tokens array<int>"), "blocks")
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in counted.collect()}  # at most one row for each token of the templates
    rank = [0] * len(words)
    for place, token in enumerate(sorted(range(len(words)), key=lambda t: (frequency.get(t, 0), t))):
        rank[token] = place
    number = {t: k for k, t in enumerate(words)}
    index = context.broadcast(Index([(name, [number[t] for t in own]) for name, own in sets], rank, threshold))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            at, which, overlaps = [], [], []
            for row, known in enumerate(batch.column(4).to_pylist()):
                for k, overlap in own.matches(known):
                    at.append(row)
                    which.append(k)
                    overlaps.append(overlap)
            rows = batch.select(["doc_id", "block_kind", "block_no", "block_lines"]).take(pa.array(at, pa.int64()))
            sizes = [len(own.sets[k]) for k in which]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([own.names[k] for k in which], pa.string()), pa.array(overlaps, pa.int32()), pa.array(sizes, pa.int32())],
                [*rows.schema.names, "template", "overlap", "template_tokens"],
            )

    return blocks.mapInArrow(join, f"doc_id {kind}, {_MATCH}")


def op4_license_join(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def scan_sql(table: str = "documents", threshold: float = 0.8) -> str:
    """All pairs, by plain counting of shared tokens."""
    rows = ", ".join(f"('{name}', '{t}', {len(own)}, {needed(len(own), threshold)})" for name, text in TEMPLATES.items() if (own := tokens(text)) for t in own)
    return f"""
with texts as (select row_number() over () as r, doc_id, string_split(text, chr(10)) as ls from {table}),
numbered as (select r, doc_id, unnest(range(len(ls))) as no, unnest(ls) as line from texts),
marked as (select *, regexp_matches(line, '[A-Za-z0-9]') as has from numbered),
runs as (select *, sum((not has)::int) over (partition by r order by no) as run from marked),
blocks as (
  select r, doc_id, 'line' as block_kind, no as block_no, 1 as block_lines, line as block from marked where has
  union all
  select r, doc_id, 'paragraph', min(no), count(*), string_agg(line, ' ' order by no) from runs where has group by r, doc_id, run having count(*) > 1),
words as (select distinct r, doc_id, block_kind, block_no, block_lines, unnest(string_split_regex(lower(block), '[^a-z0-9]+')) as token from blocks),
templates(template, token, template_tokens, need) as (values {rows})
select doc_id, block_kind, block_no::int as block_no, block_lines::int as block_lines, template, count(*)::int as overlap, template_tokens
from words join templates using (token)
group by r, doc_id, block_kind, block_no, block_lines, template, template_tokens, need having count(*) >= need"""
