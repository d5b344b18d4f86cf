"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words. The CGK random walk (Chakraborty, Goldenberg and
Koucky, 2016) reads a sequence with one random bit for each word and step: the
walk shows the word it stands on and moves on if the bit is 1. Sequences at a
small edit distance show words at a small Hamming distance, and a hash of a few
sampled steps collides for them often. Windows of the items' sizes slide over
all words of a document; each repetition has its own walk and samples, and each
window size gets as many repetitions as a trial with its windows, edited as much
as allowed, needs for the target recall. Where ``MOST_ROUNDS`` don't reach it,
items are found exactly: of an item's pieces, one more than its edits, one lies
unchanged in every match. What is found is verified by the edit distance itself.

Before the walk, two counts that every true match must reach drop windows: words
known to the items, and rare ones among these. They never drop a match. Unknown
words follow each text, so that a window may begin where fewer words remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_slices, mix, plain_words, stored

#: Edits, as a share of the item's words, up to which a passage counts as the item.
EDITS = 0.15
#: Items of fewer words can't be told from ordinary text: only a document with just their words holds them.
MIN_WORDS = 5
RECALL = 0.98
SAMPLES, MOST_ROUNDS = 3, 24
#: Pieces found in texts that are looked at together, about.
BLOCK = 1 << 19
#: Edited windows of each size in the trial.
TRIALS = 400
MOST_WINDOW = 256
#: Words known to more than this share of the items count as frequent.
FREQUENT = 0.02
#: Words of items in one pass over the documents; more take further passes.
PASS_WORDS = 1_000_000

PAD = -1


def window_sizes() -> list[int]:
    """Window sizes, each at most a quarter above the one before."""
    out = [MIN_WORDS]
    while out[-1] < MOST_WINDOW:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


@dataclass
class Pieces:
    """Pieces of one size: sorted hashes, with the owner item of each and its offset there."""

    size: int
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray


@dataclass
class Family:
    """Windows of one size: owner item, offset in it, words, most edits; and the counts a match must reach."""

    size: int
    item: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    known: int = 1 << 30
    rare: int = 1 << 30
    tables: list = field(default_factory=list)


def _walk(ids: np.ndarray, at: np.ndarray, size: int, bits: list[np.ndarray], steps: list[int]) -> np.ndarray:
    """A hash of the words that walks from ``at`` over ``size`` words show at ``steps``.

    ``bits`` holds 64 steps' bits of each word of ``ids`` in a 64-bit number.
    """
    here, end = at.copy(), at + size
    value = np.full(len(at), 0x51ED, np.uint64)
    for step in range(steps[-1] + 1):
        inside = here < end
        spot = np.minimum(here, end - 1)
        if step in steps:
            shown = np.where(inside, ids[spot], PAD).astype(np.int64).view(np.uint64)
            value = mix(value * np.uint64(3) + shown)
        here += ((bits[step >> 6][spot] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64) * inside
    return value


def _run_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each of ``at``."""
    value = np.full(len(at), 0x9D5, np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(3) + ids[at + k].astype(np.uint64))
    return value


class Searcher:
    """Items made ready for a search; sent to the tasks as a whole, of bounded size."""

    def __init__(self, item_ids: list[int], texts: list[str], edits: float = EDITS, recall: float = RECALL, seed: int = 5):
        hashes, first = plain_words(pa.array(texts, pa.string()))
        own = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        chosen = [k for k, x in enumerate(own) if len(x) >= MIN_WORDS]
        brief = [k for k, x in enumerate(own) if 0 < len(x) < MIN_WORDS]
        self.item_ids = [item_ids[k] for k in (*chosen, *brief)]
        #: The short items, by their words.
        self.brief: dict[bytes, list[int]] = {}
        for number, k in enumerate(brief, len(chosen)):
            self.brief.setdefault(own[k].tobytes(), []).append(number)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own[k] for k in chosen)]))
        self.items = [np.searchsorted(self.vocabulary, own[k]) + 1 for k in chosen]
        self.edits = [int(edits * len(x)) for x in self.items]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        held = np.zeros(len(self.vocabulary) + 1, np.int64)
        for x in self.items:
            held[np.unique(x)] += 1
        self.is_rare = (held > 0) & (held <= max(1, FREQUENT * len(self.items)))
        self._rng = np.random.default_rng(seed)
        self.rares = [int(self.is_rare[x].sum()) for x in self.items]
        salts = [int(x) for x in self._rng.integers(1, 2**62, MOST_ROUNDS)]
        windows = self._windows()
        rounds = {f.size: self._rounds(f, salts, recall) for f in windows}
        self.families = [f for f in windows if rounds[f.size]]
        self.salts = salts[: max((rounds[f.size] for f in self.families), default=0)]
        self.pieces = self._pieces(sorted({k for f in windows if not rounds[f.size] for k in f.item}))
        for f in self.families:
            flat, at = np.concatenate(f.words), np.arange(len(f.words)) * f.size
            for salt in self.salts[: rounds[f.size]]:
                steps = self._steps(f.size, salt)
                keys = _walk(flat, at, f.size, self._bits(flat, salt, f.size), steps)
                order = np.argsort(keys)
                f.tables.append((keys[order], order))

    def _windows(self) -> list[Family]:
        sizes, found = window_sizes(), {}
        for k, x in enumerate(self.items):
            n = max(s for s in sizes if s <= len(x))
            parts = max(1, len(x) // n)  # of disjoint windows, one has at most its share of the edits
            most = self.edits[k] // parts
            for at in sorted({*range(0, parts * n, n), len(x) - n}):
                f = found.setdefault(n, Family(n))
                words = x[at : at + n]
                f.item.append(k), f.offset.append(at), f.words.append(words), f.edits.append(most)
                f.known = min(f.known, n - most)
                f.rare = min(f.rare, int(self.is_rare[words].sum()) - most)
        return [found[n] for n in sorted(found)]

    @staticmethod
    def _steps(size: int, salt: int) -> list[int]:
        """The sampled steps: within the 2 * size steps that a walk needs on average."""
        return sorted(np.random.default_rng(salt).choice(2 * size, min(SAMPLES, 2 * size), replace=False).tolist())

    @staticmethod
    def _bits(ids: np.ndarray, salt: int, size: int) -> list[np.ndarray]:
        base = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return [mix(base ^ np.uint64(salt + block)) for block in range((2 * size >> 6) + 1)]

    def _rounds(self, f: Family, salts: list[int], recall: float) -> int:
        """Repetitions by which windows of ``f`` with as many edits as allowed collide with chance ``recall``; 0 if ``salts`` are too few.

        Counted over windows and repetitions together, so that windows that rarely collide aren't made up for by others.
        """
        rng, rows = np.random.default_rng(17), []
        for k in range(TRIALS):
            own = int(rng.integers(len(f.words))) if len(f.words) > TRIALS else k % len(f.words)
            edited = list(f.words[own])
            for _ in range(f.edits[own]):
                at, kind = int(rng.integers(len(edited))), int(rng.integers(3))
                if kind == 0:
                    edited[at] = 0
                elif kind == 1 and len(edited) > 1:
                    del edited[at]
                else:
                    edited.insert(at, 0)
            rows.append(np.concatenate([f.words[own], (edited + [0] * f.size)[: f.size]]))
        flat, at = np.concatenate(rows).astype(np.int64), np.arange(2 * TRIALS) * f.size
        caught = np.zeros(TRIALS, bool)
        need = recall + 2 * np.sqrt(recall * (1 - recall) / TRIALS)  # two standard errors of the trial
        for k, salt in enumerate(salts, 1):
            keys = _walk(flat, at, f.size, self._bits(flat, salt, f.size), self._steps(f.size, salt))
            caught |= keys[0::2] == keys[1::2]
            if caught.mean() >= need:
                return k
        return 0

    def _pieces(self, chosen: list[int]) -> list[Pieces]:
        """The disjoint pieces of the items ``chosen``: each edit changes one at most, so a match holds one unchanged."""
        found: dict[int, list] = {}
        for k in chosen:
            x, n = self.items[k], self.edits[k] + 1
            cuts = [len(x) * j // n for j in range(n + 1)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                found.setdefault(to - at, []).append((k, at))
        out = []
        for size, owners in sorted(found.items()):
            item, offset = np.array(owners, np.int64).T
            flat = np.concatenate([self.items[k][at : at + size] for k, at in owners])
            keys = _run_hashes(flat, np.arange(len(owners)) * size, size)
            order = np.argsort(keys, kind="stable")
            out.append(Pieces(size, keys[order], item[order], offset[order]))
        return out

    def _unchanged(self, ids: np.ndarray, first: np.ndarray, known: np.ndarray, rare: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, where it would start, a word in the match) of each piece in the texts, if the counts around it allow a match."""
        pairs: list[tuple[int, int, int]] = []
        items = [np.array(x, np.int64) for x in (list(map(len, self.items)), self.edits, self.rares)]
        for p in self.pieces:
            if len(ids) < p.size:
                continue
            at = np.flatnonzero(known[p.size :] - known[: -p.size] == p.size)
            at = at[at + p.size <= first[np.searchsorted(first, at, side="right")]]
            keys = _run_hashes(ids, at, p.size)
            low, high = np.searchsorted(p.keys, keys, "left"), np.searchsorted(p.keys, keys, "right")
            hit = np.flatnonzero(high > low)
            sums = np.cumsum(high[hit] - low[hit])
            for block in np.split(hit, np.flatnonzero(np.diff(sums // BLOCK)) + 1):  # many items may share a piece
                n = high[block] - low[block]
                inside = np.repeat(at[block], n)
                entry = np.repeat(low[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
                item = p.item[entry]
                start = inside - p.offset[entry]
                size, most, rares = (x[item] for x in items)
                doc = np.searchsorted(first, inside, side="right") - 1
                begin, end = np.maximum(first[doc], start - most), np.minimum(first[doc + 1], start + size + most)
                fits = (known[end] - known[begin] >= size - most) & (rare[end] - rare[begin] >= rares - most)
                pairs += zip(item[fits].tolist(), start[fits].tolist(), inside[fits].tolist(), strict=True)
        return pairs

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's numbers of words, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    @staticmethod
    def _padded(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids`` with ``pad`` unknown words after each text, so that windows may run over its end; each word's place in ``ids``, and each text's first word."""
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        bounds = first + pad * np.arange(len(first))
        out, origin = np.zeros(bounds[-1], np.int64), np.full(bounds[-1], -1, np.int64)
        to = np.arange(len(ids)) + pad * texts
        out[to], origin[to] = ids, np.arange(len(ids))
        return out, origin, bounds

    def distance(self, item: int, text: np.ndarray) -> int:
        """The least edit distance of the item to any part of ``text``."""
        words, n = self.items[item], len(text)
        steps = np.arange(n + 1)
        row = np.zeros(n + 1, np.int64)
        for k, word in enumerate(words, 1):
            new = np.minimum(row + 1, np.concatenate([[k], row[:-1] + (text != word)]))
            row = np.minimum.accumulate(new - steps) + steps
        return int(row.min())

    def search(self, texts: pa.Array) -> list[dict[int, tuple[int, int]]]:
        """For each text: item number -> (edit distance, word at which it is found)."""
        hashes, first = plain_words(texts)
        found: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(first) - 1)]
        if self.brief:
            for doc in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < MIN_WORDS)).tolist():
                found[doc] = {k: (0, 0) for k in self.brief.get(hashes[first[doc] : first[doc + 1]].tobytes(), ())}
        if not len(hashes) or not self.items:
            return found
        ids = self._ids(hashes)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        rare = np.concatenate([[0], np.cumsum(self.is_rare[ids])])
        pairs = self._unchanged(ids, first, known, rare)
        places = []
        pad = max((f.size for f in self.families), default=0)
        padded, origin, bounds = self._padded(ids, first, pad)
        known = np.concatenate([[0], np.cumsum(padded > 0)])
        rare = np.concatenate([[0], np.cumsum(self.is_rare[padded])])
        for f in self.families:
            at = np.flatnonzero((known[f.size :] - known[: -f.size] >= f.known) & (rare[f.size :] - rare[: -f.size] >= f.rare))
            owner = np.searchsorted(bounds, at, side="right") - 1
            places.append(at[at + f.size <= bounds[owner + 1]])
        for k, salt in enumerate(self.salts):
            due = [(f, at) for f, at in zip(self.families, places, strict=True) if len(at) and k < len(f.tables)]
            bits = self._bits(padded, salt, max(f.size for f, _ in due)) if due else []
            for f, at in due:
                keys = _walk(padded, at, f.size, bits, self._steps(f.size, salt))
                sorted_keys, order = f.tables[k]
                low, high = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
                hit = np.flatnonzero(high > low)
                n = high[hit] - low[hit]
                inside = np.repeat(origin[at[hit]], n)
                entry = order[np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                start = inside - np.array(f.offset, np.int64)[entry]
                pairs += zip(np.array(f.item, np.int64)[entry].tolist(), start.tolist(), inside.tolist(), strict=True)
        last = (-1, -1, 0)
        for item, start, inside in sorted(set(pairs)):
            doc = int(np.searchsorted(first, inside, side="right")) - 1
            best, most, n = found[doc].get(item), self.edits[item], len(self.items[item])
            if best and best[0] == 0 or last[:2] == (item, doc) and start - last[2] <= most:
                continue  # what lies around a start up to ``most`` words before has been verified
            last = (item, doc, start)
            low, high = max(first[doc], start - 2 * most), min(first[doc + 1], start + n + 2 * most)
            text = ids[low:high]
            if len(text) < n - most or np.isin(text, self.items[item]).sum() < n - most:
                continue
            d = self.distance(item, text)
            if d <= most and (best is None or d < best[0]):
                found[doc][item] = (d, int(max(start, first[doc]) - first[doc]))
        return found


FOUND = "row long, items array<long>, edits array<int>, places array<int>"


def _pass(docs: DataFrame, searcher: Searcher) -> DataFrame:
    """(row, items, edits, places) of every row of (row, text)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sorted((searcher.item_ids[k], *v) for k, v in x.items()) for x in searcher.search(batch.column(1))]
        column = lambda k, kind: pa.array([[r[k] for r in x] for x in rows], pa.list_(kind))
        return pa.record_batch([batch.column(0), column(0, pa.int64()), column(1, pa.int32()), column(2, pa.int32())], names=["row", "items", "edits", "places"])

    return map_slices(docs, "text", one, FOUND)


def searchers(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[tuple[Searcher, bool]]:
    """Searchers that hold all items between them, each of bounded size, and whether each is the only one; one at least."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // (5 * PASS_WORDS)))
    for k in range(passes):
        some = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = some.orderBy("item_id", "text").collect()  # bounded: a pass takes about PASS_WORDS words
        yield Searcher([r["item_id"] for r in rows], [r["text"] for r in rows]), passes == 1


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, contaminated, and the items found with their edits and places.

    A document holds an item if some run of its words is within ``EDITS`` times
    the item's words of the item by edit distance; an item of fewer than five
    words, if it has just these words. Words are lower-cased runs of letters and
    digits. Null and empty texts hold nothing, null items and those without words
    are in none; equal items are all named. Each row is judged by its own text,
    however many passes the items take: equal rows give equal rows, rows that
    share an id, or have none, stay apart. Empty tables give empty or clean
    results; further columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered, parts = None, []
    for searcher, alone in searchers(benchmark, item_col, item_text_col):
        if alone:
            found = _pass(own.select(F.col("doc_id").alias("row"), "text"), searcher)
            return found.select(F.col("row").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", "edits", "places")
        if numbered is None:  # rows get numbers of their own, which hold once they are written
            numbered = stored(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
        # stored, so that the driver holds one searcher at a time
        parts.append(stored(_pass(numbered.select("row", "text"), searcher).filter(F.size("items") > 0), "found"))
    each = F.explode(F.arrays_zip("items", "edits", "places")).alias("x")
    listed = reduce(DataFrame.unionByName, parts).select("row", each).groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    none = F.array().cast("array<struct<items:long,edits:int,places:int>>")
    out = numbered.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("xs", none).alias("xs"))
    return out.select("doc_id", (F.size("xs") > 0).alias("contaminated"), F.size("xs").alias("n_items"), *(F.col(f"xs.{c}").alias(c) for c in ("items", "edits", "places")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all columns; each row is judged by its own text."""
    for searcher, alone in searchers(benchmark, item_col, item_text_col):
        docs = filter_texts(docs, text_col, lambda texts, searcher=searcher: [not x for x in searcher.search(texts)])
        docs = docs if alone else stored(docs, "clean")
    return docs
