"""Language identification with averaged hashed subword embeddings.

The model follows fastText's classifier (Joulin et al., 2016): the character
2-, 3- and 4-grams of the lower-cased text, with every run of other characters
than letters as one space, are hashed into ``buckets`` rows of an embedding
matrix; a document is the average of its rows, and a linear softmax gives the
languages' probabilities.  It is trained here, in numpy, by stochastic gradient
descent on the labelled rows of the corpus: a hash sample of about
``sample_rows`` of them (the documented bound; the model does not need more with
the corpus), each whole and, where it has several lines, by one of them besides
(chosen by a hash of the text), so that short texts are known too.  Subwords are
counted where the texts are: the driver gets two examples a row at most, of at
most ``buckets`` numbers and shares each (8 bytes), however long a text is.

*Calibration.*  A fifth of the sample is held out.  A temperature that minimises
its log-loss makes the probabilities honest, and the rejection threshold is the
smallest confidence above which the held-out accuracy reaches ``precision``.
Below it the language is ``und``.

Scoring reads every text whole, in Arrow batches.  Since a linear layer commutes
with the average, workers get the product of embeddings and weights, one small
fixed table of ``buckets`` rows.

Defined results: a text without letters (null and empty too) is ``und`` with
confidence 0; rows without a label are scored but not trained on; with no labelled
row at all everything is ``und``; with one label only, that label has confidence 1;
a null id is returned with its language; repeated rows are returned each, and
are held out or trained on together; texts are read whole; an empty table gives
an empty table; ties go to the first language in alphabetical order; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.staging import ship

ORDERS = (2, 3, 4)
#: Rows of the embedding matrix.
BUCKETS = 1 << 15
_OTHER = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # embeddings @ weights, one row for each bucket
    bias: np.ndarray
    temperature: float
    threshold: float
    held_out_accuracy: float

    def confidences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language (-1: none) and its calibrated probability, for each text."""
        best, sure = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        if not self.languages:
            return best, sure
        for k, text in enumerate(texts):
            grams = ngrams(text, len(self.scores)) if text else None
            if grams is not None and len(grams):
                p = softmax((self.scores[grams].mean(axis=0, dtype=np.float64) + self.bias) / self.temperature)
                best[k] = p.argmax()
                sure[k] = p[best[k]]
        return best, sure


def ngrams(text: str, buckets: int) -> np.ndarray:
    """Bucket numbers of all subwords of a text; none if it has no letter."""
    words = _OTHER.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    value = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for order in range(1, max(ORDERS) + 1):
            if len(points) < order:
                break
            value = value[: len(points) - order + 1] * np.uint32(0x01000193) + points[order - 1 :]
            if order in ORDERS:
                mixed = (value ^ np.uint32(order)) * np.uint32(0x9E3779B1)
                found.append((mixed >> np.uint32(8)) & np.uint32(buckets - 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


Example = tuple[np.ndarray, np.ndarray, str]


def examples_of(text: str, language: str, buckets: int) -> list[Example]:
    """Subwords, their shares and the language: of the whole text, and of one of its lines if it has several."""
    import xxhash

    lines = [line for line in text.split("\n") if line.strip()]
    one = [lines[xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % len(lines)]] if len(lines) > 1 else []
    out = []
    for piece in [text, *one]:
        grams, times = np.unique(ngrams(piece, buckets), return_counts=True)
        if len(grams):
            out.append((grams.astype(np.int32), (times / times.sum()).astype(np.float32), language))
    return out


def train(rows: list[tuple[str, str]], buckets: int = BUCKETS, **params) -> Model:
    """A model from ``(text, language)`` rows."""
    return fit([examples_of(text, language, buckets) for text, language in rows], buckets, **params)


def fit(rows: list[list[Example]], buckets: int = BUCKETS, width: int = 16, epochs: int = 5, rate: float = 0.5, precision: float = 0.99, seed: int = 3) -> Model:
    """A model from the examples of rows; every fifth row is held out."""
    rng = np.random.RandomState(seed)
    languages = sorted({language for own in rows for _, _, language in own})
    number = {language: k for k, language in enumerate(languages)}
    examples = [(grams, share, number[language], k % 5 == 4) for k, own in enumerate(rows) for grams, share, language in own]
    learn = [e for e in examples if not e[3]]
    held = [e for e in examples if e[3]] or learn
    if not learn:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 2.0, 0.0)
    table = ((rng.rand(buckets, width) - 0.5) * (2 / width)).astype(np.float32)
    weights, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    total, done = epochs * len(learn), 0
    for _ in range(epochs):
        for at in rng.permutation(len(learn)):
            grams, share, truth, _ = learn[at]
            step = rate * (1 - done / total)
            hidden = share @ table[grams]
            error = softmax(hidden @ weights + bias).astype(np.float32)
            error[truth] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= step * error
            # the document's average passes its gradient on in proportion; scaled by
            # their number, as rows would hardly move otherwise
            table[grams] -= step * min(len(grams), 200) * share[:, None] * back
            done += 1
    scores = table @ weights
    logits = np.array([share @ scores[grams] + bias for grams, share, _, _ in held], np.float64)
    truth = np.array([t for _, _, t, _ in held])
    temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: _loss(logits / t, truth))
    p = np.array([softmax(x / temperature) for x in logits])
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-sure, kind="stable")
    reached = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    threshold = float(sure[order][np.flatnonzero(reached)[-1]]) if reached.any() else float(sure.max())
    return Model(languages, scores, bias.astype(np.float64), float(temperature), threshold, float(right.mean()))


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float(-(logits[np.arange(len(truth)), truth] - top[:, 0] - np.log(np.exp(logits - top).sum(axis=1))).mean())


def labelled_examples(docs: DataFrame, sample_rows: int, buckets: int = BUCKETS) -> list[list[Example]]:
    """Examples of about ``sample_rows`` labelled rows, chosen by a hash of id and text, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            found = [(doc_id, piece, *own) for doc_id, text, language in rows for piece, own in enumerate(examples_of(text, language, buckets))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], batch.schema.field(0).type),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2].tobytes() for f in found], pa.binary()),
                    pa.array([f[3].tobytes() for f in found], pa.binary()),
                    pa.array([f[4] for f in found], pa.string()),
                ],
                ["doc_id", "piece", "grams", "shares", "lang"],
            )

    ship(docs.sparkSession)
    labelled = docs.filter("lang is not null and text is not null")
    n = labelled.select("lang").count()
    part = min(1.0, sample_rows / max(1, n))
    chosen = F.xxhash64(F.lit("lang-sample"), "doc_id", F.length("text")).bitwiseAND(F.lit((1 << 32) - 1)) < F.lit(int(part * (1 << 32)) + 1)
    narrow = labelled.filter(chosen).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = narrow.mapInArrow(run, "doc_id long, piece int, grams binary, shares binary, lang string").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["lang"], r["grams"], r["shares"]))
    return [[(np.frombuffer(r["grams"], np.int32), np.frombuffer(r["shares"], np.float32), r["lang"]) for r in own] for _, own in groupby(got, key=lambda r: r["doc_id"])]


_OUT = "doc_id long, best string, confidence double, language string"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, best, confidence, language)`` of every row; ``language`` is ``und`` where rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            best, sure = model.confidences(batch.column(1).to_pylist())
            sure = np.round(sure, 6)
            taken = np.where((best >= 0) & (sure >= round(model.threshold, 6)), best, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(sure), pa.array(names[taken], pa.string())], ["doc_id", "best", "confidence", "language"]
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def label_corpus(docs: DataFrame, sample_rows: int = 3000, **params) -> DataFrame:
    return identify(docs, fit(labelled_examples(docs, sample_rows), **params))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return label_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
