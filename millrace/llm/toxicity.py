"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model of its
words and of their beginnings; the document's score is the noisy-or of its
sentences', 1 - prod(1 - p), so labels of documents train a model that points at
sentences. Weights are kept sparse by soft thresholding, which leaves rare words
at zero.

Training takes a bounded sample of labelled documents, those with the smallest
hashes of their ids; scoring takes all documents, whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_slices

#: Labelled documents that a model is fitted on, at most, and the characters of each: longer ones aren't learned from.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 20_000
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
#: Documents of the sample that must hold a feature.
LEAST_DOCS = 4
STEPS, RATE, SPARSE = 160, 0.15, 1e-4
#: Entries of the training matrix handled at once.
PIECE = 2_000_000
CUTOFF = 0.3
#: Words whose weights a Python worker keeps.
CACHE_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[str]:
    return _SENTENCE.findall(text or "")


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in _features(word))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Weights that maximise the noisy-or likelihood of the documents' labels."""
    y = np.array(labels, float)
    words: dict[str, int] = {}
    names: dict[str, int] = {}
    flat, ends = array("i"), array("q", [0])

    def number(word: str) -> int:
        k = words.setdefault(word, len(words))
        if k == len(ends) - 1:  # a new word: its features
            flat.extend(names.setdefault(f, len(names)) for f in _features(word))
            ends.append(len(flat))
        return k

    docs = []
    for text in texts:
        bags = (array("i", map(number, _WORD.findall(s))) for s in sentences((text or "").lower()))
        docs.append([b for b in bags if b])
    feats, ends = np.array(flat), np.array(ends)

    def features_of(some: np.ndarray) -> np.ndarray:
        """The distinct features of some words."""
        size = ends[some + 1] - ends[some]
        first = np.repeat(ends[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.unique(feats[first + np.arange(size.sum())])

    held = np.zeros(len(names), np.int64)
    for bags in docs:
        if bags:
            held[features_of(np.unique(np.concatenate(bags)))] += 1
    known = held >= LEAST_DOCS
    place = np.cumsum(known) - 1
    if not known.any() or not y.any() or y.all():
        share = float(np.clip(y.mean() if len(y) else 0.01, 0.001, 0.999))
        return Model({}, float(np.log(share / (1 - share))))
    pieces, cols, starts, doc_of = [], array("i"), array("i"), array("i")
    for d, bags in enumerate(docs):
        for b in bags:
            own = features_of(np.unique(b))
            own = place[own[known[own]]]
            if len(own):
                starts.append(len(cols))
                cols.frombytes(own.astype(np.int32).tobytes())
                doc_of.append(d)
        if len(cols) >= PIECE or d == len(docs) - 1 and cols:
            pieces.append(tuple(np.frombuffer(x, np.int32) for x in (cols, starts, doc_of)))
            cols, starts, doc_of = array("i"), array("i"), array("i")
    docs.clear()
    known = {f: int(place[k]) for f, k in names.items() if known[k]}
    w, bias = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        chance, none = [], np.full(len(y), -1e-9)
        for cols, starts, doc_of in pieces:
            p = 1 / (1 + np.exp(-np.add.reduceat(w[cols], starts) - bias))
            none -= np.bincount(doc_of, weights=-np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
            chance.append(p)
        some = -np.expm1(none)  # the documents' noisy-or
        push = np.where(y == 1, -(1 - some) / some, 1.0) / len(y)
        g, gb = np.zeros_like(w), 0.0
        for (cols, starts, doc_of), p in zip(pieces, chance, strict=True):
            pull = push[doc_of] * p
            g += np.bincount(cols, weights=np.repeat(pull, np.diff(starts, append=len(cols))), minlength=len(w))
            gb += pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE / np.sqrt(1 + step / 40)
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-6
        w -= rate * (m / (1 - 0.9**step)) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE / scale, 0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return Model({f: float(w[k]) for f, k in known.items() if w[k]}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled documents outside the held-out quarter, of at most ``TRAIN_CHARS`` characters each.

    Rows with a null label or id are left out.
    """
    marked = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("label_id").isNotNull())
    chosen = marked.filter(~held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id", F.lit("train")), "label_id", "label").limit(most)
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS)
    rows = own.join(chosen, "label_id").orderBy("label_id", "label", "text").limit(most).collect()  # bounded: ``most`` times TRAIN_CHARS
    return [r["text"] or "" for r in rows], [r["label"] for r in rows]


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


class Scorer:
    """Scores texts and their sentences; a worker keeps the weights of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[float, np.ndarray]]:
        """Each text's score, and its sentences' chances."""
        known, bias = self.known, self.model.bias
        if len(known) > CACHE_WORDS:
            known.clear()
        for text in texts.to_pylist():
            z = []
            for sentence in sentences((text or "").lower()):
                total, words = bias, set(_WORD.findall(sentence))
                for w in words:
                    value = known.get(w)
                    if value is None:
                        value = known[w] = self.model.word(w)
                    total += value
                z.append(total if words else -np.inf)
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700))) if z else np.zeros(0)
            p[np.isneginf(z)] = 0
            yield float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p


SCHEMA = "doc_id long, score double, n_sentences int, offending array<int>"


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, n_sentences, offending (places of sentences that score at least ``CUTOFF``).

    Null, empty and wordless texts have no sentence and score 0. Equal rows give
    equal rows; an empty table gives an empty result; further columns are not
    looked at.
    """
    scorer = Scorer(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, counts, spots = [], [], []
        for score, p in scorer(batch.column(1)):
            scores.append(score)
            counts.append(len(p))
            spots.append(np.flatnonzero(p >= CUTOFF).tolist())
        return pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spots, pa.list_(pa.int32()))], names=["doc_id", "score", "n_sentences", "offending"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(own, "text", one, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Scores with ``held_out`` and ``predicted`` (1 from a score of 0.3 on)."""
    model = fit(*sample(docs, labels, id_col, text_col, label_col))
    scored = score_documents(docs, model, id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "n_sentences", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose text scores below the cutoff, with all columns; each row is judged by its own text."""
    scorer = Scorer(fit(*sample(docs, labels, id_col, text_col, label_col)))
    return filter_texts(docs, text_col, lambda texts: [score < CUTOFF for score, _ in scorer(texts)])
