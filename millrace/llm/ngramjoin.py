"""Similarity join on word n-grams with Bayesian candidate pruning.

1. Each text becomes the set of hashes of its runs of five words; texts with
   the same set form a class, told apart by 128 bits and represented by the text
   of its smallest id.
2. MinHash values of the representatives are cut into bands; representatives
   that share a band are linked to the smallest of their bucket, so a bucket of n
   texts costs n rows. Connected components of these links hold all candidates.
3. Candidates are compared in tasks: small components whole and many to a task,
   large ones as pairs of blocks, or bucket by bucket where that sends fewer
   texts, as for long chains; a pair that shares several buckets counts in the
   first. A task compares MinHash values step by step, drops a pair as soon as the
   posterior probability that it reaches the threshold is below the tolerance, and
   counts the rest exactly from the sets. It returns, per text, the number of its
   links and one neighbour for its local group, so the rows grow with the texts
   and not with the pairs.
4. The local groups are joined to the classes' final groups.

Joins that meet a hub, a large class or a large component broadcast the facts of
these keys, whose number is bounded, and shuffle the others.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_ids, cut, map_slices, plain_words, slices, spread_join, stored, unused, window_hashes

WORDS = 5
THRESHOLD = 0.8
#: 36 bands of 6 values: a pair at similarity 0.8 shares no band with probability 2e-5.
BANDS, ROWS = 36, 6
STEP = 24
#: Smallest posterior probability of reaching the threshold with which a pair is kept.
TOLERANCE = 1e-6
#: Texts, and characters of text, in a block of a large component.
BLOCK_TEXTS, BLOCK_CHARS = 1024, 2_000_000
#: Texts compared at once inside a task.
TILE = 256

_RNG = np.random.default_rng(7_919)
_MULTIPLY = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def ngram_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after the other, and their offsets.

    A text of one to n-1 words has one n-gram, all its words; one without words has none.
    """
    words, first = plain_words(texts)
    keys, at = window_hashes(words, first, n)
    owner = np.searchsorted(first, at, side="right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    extra = np.array([int.from_bytes(hashlib.blake2b(words[first[k] : first[k + 1]].tobytes(), digest_size=8).digest(), "little") for k in short], np.uint64)
    keys, owner = np.concatenate([keys, extra]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(texts) + 1))


def minhashes(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row a set; empty sets get the largest values."""
    out = np.full((len(offsets) - 1, BANDS * ROWS), 2**32 - 1, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        folded = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
        starts = offsets[:-1][full]
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat((folded ^ _FLIP[k]) * _MULTIPLY[k], starts)
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``n`` values with which a pair is kept.

    Under a uniform prior the similarity's posterior after m matches is
    Beta(m + 1, n - m + 1); it exceeds the threshold with the probability that a
    binomial of n + 1 trials at the threshold is at most m.
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def _exact(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``a[i]`` and ``b[j]`` for rows (i, j) of ``pairs``."""
    if len(pairs) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], np.int64)
    keys, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    common = np.bincount(where, minlength=len(keys)) > 1
    column = np.cumsum(common) - 1
    out = np.zeros(len(pairs), np.float32)
    own = common[where]
    where, owner = column[where[own]], owner[own]
    for at in range(0, int(common.sum()), 4096):  # a strip of shared n-grams at a time
        some = (where >= at) & (where < at + 4096)
        grid = np.zeros((len(a) + len(b), 4096), np.float32)
        grid[owner[some], where[some] - at] = 1
        out += (grid[: len(a)] @ grid[len(a) :].T)[pairs[:, 0], pairs[:, 1]]
    return out.astype(np.int64)


class Links:
    """Links found among texts: counts, and local groups."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.count, i, copies[j])
        np.add.at(self.count, j, copies[i])
        root = self.root
        while True:  # minimum labels over the links, then their shortcuts
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root[:] = root[root]
            if np.array_equal(before, root):
                return


def compare(links: Links, sets: list[np.ndarray], signs: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, slot: int = -1) -> None:
    """Compare all pairs of texts ``left`` x ``right`` (i < j where these are the same), but those that share a band before ``slot``."""
    sizes = np.array([len(x) for x in sets], np.int64)
    needed = [(k, least_matches(k, threshold, tolerance)) for k in range(STEP, signs.shape[1] + 1, STEP)]
    same = left is right
    for a in range(0, len(left), TILE):
        x = left[a : a + TILE]
        for b in range(a if same else 0, len(right), TILE):
            y = right[b : b + TILE]
            hits = np.zeros((len(x), len(y)), np.int16)
            for k in range(STEP):
                hits += signs[x, k][:, None] == signs[y, k][None, :]
            small, large = np.minimum(sizes[x][:, None], sizes[y][None, :]), np.maximum(sizes[x][:, None], sizes[y][None, :])
            alive = (hits >= needed[0][1]) & (small >= threshold * large) & (small > 0)
            if same and a == b:
                alive &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            i, j = np.nonzero(alive)
            m = hits[i, j].astype(np.int64)
            for upto, least in needed[1:]:
                if not len(i):
                    break
                m += (signs[x[i], upto - STEP : upto] == signs[y[j], upto - STEP : upto]).sum(axis=1)
                keep = m >= least
                i, j, m = i[keep], j[keep], m[keep]
            if slot > 0 and len(i):
                agree = signs[x[i], : slot * ROWS] == signs[y[j], : slot * ROWS]
                new = ~agree.reshape(len(i), slot, ROWS).all(axis=2).any(axis=1)
                i, j = i[new], j[new]
            if len(i):
                both = _exact([sets[k] for k in x], [sets[k] for k in y], np.column_stack([i, j]))
                union = sizes[x[i]] + sizes[y[j]] - both
                near = both >= threshold * union - 1e-9
                links.add(x[i[near]], y[j[near]], copies)


# ---- the jobs ---------------------------------------------------------------

def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): each id of ``links`` (a, b) with the smallest id connected to it.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), in
    which every row points to a smaller id, until nothing changes.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = lambda: edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    state = size()
    for _ in range(rounds):
        if state["n"] == 0:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = spread_join(both.filter("b > a"), low, ["a"], "n", 2 * state["n"]).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", 2 * state["n"])
        edges = cut(small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        last, state = state, size()
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _names(keys: np.ndarray, offsets: np.ndarray) -> tuple[list[int | None], list[int | None]]:
    """The halves of a 128-bit name for each set, equal for equal sets; None for the empty set."""
    digests = [hashlib.blake2b(keys[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    read = lambda d: int.from_bytes(d, "little", signed=True)
    return [d and read(d[:8]) for d in digests], [d and read(d[8:]) for d in digests]


def signatures(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, mark, h1, h2, chars, bands): per row of (doc_id, text, mark), the name of its n-gram set, and band hashes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = ngram_sets(batch.column(1), n)
        signs = minhashes(keys, offsets)
        banded = signs.reshape(len(signs), BANDS, ROWS)
        value = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signs), 1))
        for k in range(ROWS):
            value = (value ^ banded[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        flat = pa.array(value.view(np.int64).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1, dtype=np.int32) * BANDS), flat)
        h1, h2 = _names(keys, offsets)
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), chars, bands], names=["doc_id", "mark", "h1", "h2", "chars", "bands"])

    return map_slices(docs, "text", one, "doc_id long, mark long, h1 long, h2 long, chars long, bands array<long>")


def _compare_group(part: pa.Table, threshold: float, tolerance: float, n: int) -> pa.Table:
    """Links inside one group of rows (lo, hi, comp, slot, side, node, copies, text); a node comes once in a (comp, slot)."""
    part = part.combine_chunks()
    sets, signs = [], []
    for a, b in slices(part["text"].chunk(0)):
        keys, offsets = ngram_sets(part["text"].chunk(0).slice(a, b - a), n)
        sets += [keys[i:j].copy() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        signs.append(minhashes(keys, offsets))
    signs = np.concatenate(signs)
    node, comp, slot, side, copies = (part[c].to_numpy() for c in ("node", "comp", "slot", "side", "copies"))
    apart = part["lo"][0].as_py() != part["hi"][0].as_py()
    links = Links(len(node))
    order = np.lexsort((node, side, slot, comp))
    for rows in np.split(order, np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(slot[order]) != 0)) + 1):
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        compare(links, sets, signs, copies, left, right if apart else left, threshold, tolerance, int(slot[rows[0]]))
    return pa.table({"node": pa.array(node), "n": pa.array(links.count), "near": pa.array(node[links.root])})


def _blocks(n: str, chars: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(chars) / BLOCK_CHARS)).cast("int")


def _candidates(classes: DataFrame, total: int) -> DataFrame:
    """(node, set_id, set_mark, copies, comp, slot, blocks): what is compared with what, a node in one group or in a group for each bucket."""
    banded = classes.select("node", F.posexplode("bands").alias("slot", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("m")).filter("m > 1")
    linked = stored(spread_join(banded, buckets, ["band"], "m", BANDS * total), "buckets")
    comps = components(linked.select(F.col("node").alias("a"), F.col("low").alias("b")))
    members = stored(classes.drop("bands", "h1", "h2").join(comps.select(F.col("id").alias("node"), F.col("root").alias("comp")), "node"), "members")
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    sizes = stored(sizes.withColumn("blocks", _blocks("n", "all_chars")).drop("all_chars"), "components")
    whole = spread_join(members, sizes, ["comp"], "n", total).drop("n", "chars").withColumn("slot", F.lit(-1))
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return whole
    # a large component goes by its buckets, if these send fewer texts than its pairs of blocks
    inside = spread_join(members, large, ["comp"], "n", total)
    placed = linked.select("node", "slot", "band").join(inside.drop("n", "blocks"), "node")
    fills = placed.groupBy("comp", "band").agg(F.count("*").alias("m"), F.sum("chars").alias("all_chars"))
    fills = stored(fills.withColumn("band_blocks", _blocks("m", "all_chars")), "bucket-sizes")
    costs = fills.groupBy("comp").agg(F.sum(F.col("m") * F.col("band_blocks")).alias("cost"))
    chains = stored(large.join(costs, "comp").filter("cost < n * blocks").select("comp", "n"), "chains")
    split = spread_join(placed, chains.withColumn("m", F.col("n") * BANDS).drop("n"), ["comp"], "m", BANDS * total).drop("m", "chars")
    filled = fills.join(chains.select("comp"), "comp", "left_semi").select("band", "m", F.col("band_blocks").alias("blocks"))
    split = spread_join(split, filled, ["band"], "m", BANDS * total).drop("m", "comp").withColumnRenamed("band", "comp")
    rest = sizes.join(chains.select("comp"), "comp", "left_anti")
    whole = spread_join(members, rest, ["comp"], "n", total).drop("n", "chars").withColumn("slot", F.lit(-1))
    return whole.unionByName(split.select(*whole.columns))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = WORDS) -> DataFrame:
    """Per row: doc_id, class_id, n_links, set_id.

    Two rows are linked if the Jaccard similarity of their n-gram sets is at
    least ``threshold``; ``n_links`` counts a row's links, ``class_id`` is the
    smallest id of all rows that links connect with it, ``set_id`` the smallest
    id with the same n-gram set. Words are lower-cased runs of letters and
    digits. Texts of fewer than ``n`` words are one n-gram; null texts and texts
    without words link to nothing. Rows that repeat an id are rows of their own;
    a null id counts as the smallest long. An empty table gives an empty result;
    further columns are not looked at.
    """
    return _groups(docs, id_col, text_col, threshold, tolerance, n).select("doc_id", "class_id", "n_links", "set_id")


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = WORDS) -> DataFrame:
    """``near_groups`` with mark, a hash of the row's text that tells texts of one id apart, class_mark, that of the group's first text, and has_words."""
    own = clean_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")), "doc_id")
    signed = stored(signatures(own, n), "signatures")
    classes = signed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("copies"), F.min("chars").alias("chars"), F.min("bands").alias("bands"))
    classes = classes.select("h1", "h2", F.col("least.doc_id").alias("set_id"), F.col("least.mark").alias("set_mark"), "copies", "chars", "bands", F.monotonically_increasing_id().alias("node"))
    classes = stored(classes, "classes")  # its numbers hold from here on
    total, n_rows = classes.count(), signed.count()
    groups = stored(_candidates(classes, total), "candidates")
    chars = classes.agg(F.sum("chars")).first()[0] or 0
    deal = max(256, -(-2 * chars // BLOCK_CHARS))
    placed = groups.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    # groups of one block share tasks
    share = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(deal))).otherwise(-1 - F.pmod(F.xxhash64("comp", "slot"), F.lit(2**40)))
    rows = paired.select(share.alias("share"), "lo", "hi", "comp", "slot", "side", "node", "copies", "set_id", "set_mark")
    texts = own.groupBy("doc_id", "mark").agg(F.min("text").alias("text"))  # equal rows become one where they are read
    rows = rows.join(texts, (F.col("set_id") == F.col("doc_id")) & (F.col("set_mark") == F.col("mark"))).drop("set_id", "set_mark", "doc_id", "mark")

    def run(part):
        return _compare_group(part, threshold, tolerance, n)

    found = stored(rows.groupBy("share", "lo", "hi").applyInArrow(run, "node long, n long, near long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "node")
    known = classes.select("node", "h1", "h2", "set_id", "set_mark", "copies").join(roots, "node", "left").join(counts, "node", "left")
    links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    known = stored(known.select("h1", "h2", "set_id", "set_mark", "copies", links.alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    first = known.groupBy("root").agg(F.min(F.struct("set_id", "set_mark")).alias("least"), F.count("*").alias("n"))
    first = first.select("root", F.col("least.set_id").alias("class_id"), F.col("least.set_mark").alias("class_mark"), "n")
    known = spread_join(known, first, ["root"], "n", total).drop("root", "n", "set_mark")
    out = spread_join(signed.select("doc_id", "mark", "h1", "h2"), stored(known, "known"), ["h1", "h2"], "copies", n_rows, "left")
    return out.select("doc_id", "mark", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_mark", "mark").alias("class_mark"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("set_id", "doc_id").alias("set_id"), F.col("h1").isNotNull().alias("has_words"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each group of near copies, with all columns: the one of the smallest id, null first.

    Among rows of that id the hash of the text decides, among rows of the same
    text a hash of all columns. Null texts and texts without words all stay.
    """
    judged = _groups(docs, id_col, text_col, **options).filter("has_words")
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    verdicts = judged.groupBy("doc_id", "mark").agg(F.max(first).alias("first"), F.count("*").alias("n")).filter("not first or n > 1")
    key, mark, told, rows = (unused(docs, x) for x in ("row_key", "row_mark", "row_first", "row_count"))
    verdicts = stored(verdicts.toDF(key, mark, told, rows), "verdicts")
    total = verdicts.agg(F.sum(rows)).first()[0] or 0
    held = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn(mark, F.xxhash64(text_col))
    out = spread_join(held, verdicts, [key, mark], rows, total, "left").filter(F.col(told).isNull()).select(*docs.columns)
    repeated = verdicts.filter(told)
    if repeated.isEmpty():
        return out
    again = spread_join(held, repeated, [key, mark], rows, total).select(key, mark, F.struct(*docs.columns).alias(told))
    chosen = again.groupBy(key, mark).agg(F.min_by(told, F.xxhash64(F.to_json(told))).alias(told))
    return out.unionByName(chosen.select(f"{told}.*"))
