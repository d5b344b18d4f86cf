"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find, inside each text, the n-grams
and lines that occur more than once; the rules look at the share of the text's
characters that such n-grams and lines cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, map_slices, mix, raw, span_hashes, window_hashes

#: N-gram length, and the largest share of word characters inside
#: n-grams of that length that the text holds twice or more.
COVERAGE = {5: 0.30, 7: 0.26, 10: 0.20}
#: Fixed value: the largest share of word characters in lines equal to an earlier line.
LINE_COVERAGE = 0.20
MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in COVERAGE)
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(keys), bool)
    out[order] = twice
    return out


def _inside(words: np.ndarray, first: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that their text holds twice or more."""
    keys, at = window_hashes(words, first, n)
    at = at[_repeated(mix(keys ^ mix(owner[at])))]
    step = np.zeros(len(words) + 1, np.int64)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of each text; null counts as empty."""
    data, offsets = raw(texts)
    starts, ends, first = blank_words(data, offsets)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = heads[ends] - heads[starts]
    words = span_hashes(data, starts, ends)
    word_chars = _per_text(chars, first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    line_owner = np.searchsorted(offsets, breaks, side="right") - 1
    line_owner = np.sort(np.concatenate([np.arange(len(texts)), line_owner]), kind="stable")
    w0, w1 = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    worded = w1 > w0
    keys = mix(span_hashes(data, line_starts, line_ends) ^ mix(line_owner.astype(np.uint64)))[worded]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    held = np.concatenate([[0], np.cumsum(chars)])
    line_chars = (held[w1] - held[w0])[worded]
    line_of = line_owner[worded]
    out = {
        "n_words": np.diff(first),
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_of[again], minlength=len(texts)),
        "n_repeat_words": _per_text(_inside(words, first, owner, REPEAT_WINDOW), first),
    }
    most = np.maximum(word_chars, 1)
    out["dup_line_share"] = np.bincount(line_of[again], weights=line_chars[again], minlength=len(texts)) / most
    for n in COVERAGE:
        out[f"dup_{n}gram_share"] = _per_text(np.where(_inside(words, first, owner, n), chars, 0), first) / most
    return out


def repetition_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: word, symbol and repetition measures of the whole text.

    Null and empty texts measure 0 everywhere; equal rows give equal rows; an
    empty table gives an empty result; further columns are not looked at.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(batch.column(1))
        return pa.record_batch([batch.column(0), *(pa.array(v.astype(float) if k.endswith("share") else v.astype(np.int64)) for k, v in found.items())], names=["doc_id", *found])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(own, "text", one, SCHEMA)


def apply_rules(measures: DataFrame) -> DataFrame:
    """``base_failed`` and ``kept`` beside the measures."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    method = F.col("dup_line_share") <= LINE_COVERAGE
    for n, most in COVERAGE.items():
        method &= F.col(f"dup_{n}gram_share") <= most
    return measures.withColumn("base_failed", base).withColumn("kept", ~base & method)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return apply_rules(repetition_measures(docs, id_col, text_col))
