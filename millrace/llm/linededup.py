"""Exact line deduplication over a sharded minimal perfect hash.

1. Each document gives the distinct 128-bit hashes of its line keys.
2. A combinable aggregation counts documents and keeps the largest id per key.
3. All distinct keys are dealt to shards; each shard holds a minimal perfect hash
   and, in its order, 32-bit fingerprints, saturating 16-bit counts and largest ids.
4. The documents' hashes probe these arrays, shard by shard, and the counts decide
   which lines go; shards that many documents probe are copied to several
   probing groups, in proportion to the probes counted for them. Lines are never
   joined with lines.
5. The keys that a document loses go back to it by id; its text is rebuilt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_ids, map_slices, mix, spread_join, stored

BLANKS = b" \t\n\x0b\x0c\r"
#: Keys in a shard of the hash, and probes in a probing group, on average.
SHARD_KEYS = 50_000
GROUP_PROBES = 50_000
#: Bits for each key that a level of the hash has still to place.
SPREAD = 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


# ---- the perfect hash -------------------------------------------------------

#: The largest count that the arrays tell from larger ones.
MOST_COUNT = 65_535


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level * 2 + 1) * 0xD1342543DE82EF95 % 2**64)
    return (mix(mix(h1 + step) + h2) % np.uint64(size)).astype(np.int64)


def build_levels(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of taken slots for distinct keys (h1, h2), and each key's place in 0..n-1."""
    levels, place = [], np.full(len(h1), -1, np.int64)
    left, done = np.arange(len(h1)), 0
    while len(left):
        size = max(8, SPREAD * len(left))
        at = _slot(h1[left], h2[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        rank = np.cumsum(alone) - 1
        place[left[hit]] = done + rank[at[hit]]
        done += int(alone.sum())
        levels.append(alone)
        left = left[~hit]
    return levels, place


def look_up(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's place; -1, or any place, for keys that were not built in."""
    place = np.full(len(h1), -1, np.int64)
    left, done = np.arange(len(h1)), 0
    for k, alone in enumerate(levels):
        at = _slot(h1[left], h2[left], k, len(alone))
        hit = alone[at]
        place[left[hit]] = done + (np.cumsum(alone) - 1)[at[hit]]
        done += int(alone.sum())
        left = left[~hit]
    return place


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _pack_shard(shard: int, part: pa.Table) -> dict:
    h1, h2, n_docs = _unsigned(part["h1"]), _unsigned(part["h2"]), part["n_docs"].to_numpy()
    levels, place = build_levels(h1, h2)
    order = np.argsort(place)
    probes = int(part["n_probes"].to_numpy().sum())
    return {
        "shard": shard,
        "level_sizes": [len(x) for x in levels],
        "level_bits": b"".join(np.packbits(x).tobytes() for x in levels),
        "fingerprints": h2[order].astype("<u4").tobytes(),
        "counts": np.minimum(n_docs[order], MOST_COUNT).astype("<u2").tobytes(),
        "last_ids": part["last_id"].to_numpy()[order].astype("<i8").tobytes(),
        "probes": probes,
        "copies": max(1, -(-probes // GROUP_PROBES)),
    }


def _unpack_levels(sizes: list[int], bits: bytes) -> list[np.ndarray]:
    at, out = 0, []
    for n in sizes:
        width = -(-n // 8)
        out.append(np.unpackbits(np.frombuffer(bits, np.uint8, width, at), count=n).astype(bool))
        at += width
    return out


INDEX = "shard int, level_sizes array<int>, level_bits binary, fingerprints binary, counts binary, last_ids binary, probes long, copies int"


def line_hashes(docs: DataFrame, min_points: int) -> DataFrame:
    """(doc_id, mark, h1, h2): the distinct keys of at least ``min_points`` code points of each row of (doc_id, text, mark)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, h1, h2 = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
            for key in keys:
                if len(key) >= min_points and _points(key) >= min_points:
                    a, b = _halves(key)
                    rows.append(i), h1.append(a), h2.append(b)
        at = pa.array(rows, pa.int64())
        return pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["doc_id", "mark", "h1", "h2"])

    return map_slices(docs, "text", one, "doc_id long, mark long, h1 long, h2 long")


def build_index(probes: DataFrame, alone: bool) -> tuple[DataFrame, int, int]:
    """The sharded hash of all keys with its arrays, one row a shard; the numbers of shards and of probes.

    Counts are of distinct ids; ``alone`` tells that each id has one row.
    """
    key = ["h1", "h2"]
    asked = F.count("*").alias("n_probes")
    if alone:
        counted = probes.groupBy(*key).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"), asked)
    else:
        of_ids = probes.groupBy(*key, "doc_id").agg(asked)
        counted = of_ids.groupBy(*key).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"), F.sum("n_probes").alias("n_probes"))
    counted = stored(counted, "counted")
    total = probes.count()
    shards = max(16, -(-counted.count() // SHARD_KEYS), -(-total // (4 * GROUP_PROBES)))
    shards = 1 << (shards - 1).bit_length()

    def pack(key, part):
        row = _pack_shard(key[0].as_py(), part)
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds, strict=True)})

    index = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(pack, INDEX)
    return stored(index, "line-index"), shards, total


def probe(probes: DataFrame, index: DataFrame, shards: int, total: int, min_docs: int) -> DataFrame:
    """(doc_id, mark, h1): the keys that each document loses."""
    spread = index.select("shard", "copies", "probes")  # one short row a shard
    dealt = probes.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    dealt = dealt.join(F.broadcast(spread), "shard") if shards <= 65_536 else spread_join(dealt, spread, ["shard"], "probes", total)
    part = F.pmod(F.xxhash64("doc_id", "mark", "h1"), F.col("copies").cast("long")).cast("int")
    asked = dealt.select("shard", part.alias("part"), "doc_id", "mark", "h1", "h2")
    copied = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def answer(left, right):
        names = ["doc_id", "mark", "h1"]
        if not len(left) or not len(right):
            return left.select(names).slice(0, 0)
        row = {name: right[name][0].as_py() for name in right.column_names}
        h2 = _unsigned(left["h2"])
        place = look_up(_unpack_levels(row["level_sizes"], row["level_bits"]), _unsigned(left["h1"]), h2)
        prints, counts, last = (np.frombuffer(row[c], kind) for c, kind in (("fingerprints", "<u4"), ("counts", "<u2"), ("last_ids", "<i8")))
        known = place >= 0
        safe = np.where(known, place, 0)
        lost = known & (prints[safe] == h2.astype("<u4")) & (counts[safe] >= min_docs) & (left["doc_id"].to_numpy() < last[safe])
        return left.select(names).filter(pa.array(lost))

    return asked.groupBy("shard", "part").cogroup(copied.groupBy("shard", "part")).applyInArrow(answer, "doc_id long, mark long, h1 long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row: doc_id, text without its repeated lines, n_lines before, n_dropped.

    Lines split at \\n. A line's key is the line without ASCII blanks at its
    ends, A-Z lower-cased. A key of at least ``min_points`` code points found in
    at least ``min_docs`` documents stays only in the largest id that holds it.
    Null and empty texts are one empty line. Rows of one id count as one
    document; a null id counts as the smallest long. Empty tables give an empty
    result; further columns are not looked at.
    """
    if min_docs > MOST_COUNT:
        raise ValueError(f"counts are told apart up to {MOST_COUNT}")
    own = clean_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    rows, ids = own.agg(F.count("*"), F.count_distinct("doc_id")).first()
    alone = rows == ids
    # where ids repeat, a row is told by its text besides: what it loses is bounded by its own lines
    own = own.withColumn("mark", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    hashes = line_hashes(own, min_points)
    probes = stored(hashes if alone else hashes.distinct(), "line-hashes")
    index, shards, total = build_index(probes, alone)
    lost = probe(probes, index, shards, total, min_docs).groupBy("doc_id", "mark").agg(F.collect_set("h1").alias("lost"))

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or "").encode().split(b"\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                kept = []
                for x in lines:
                    key = line_key(x)
                    if len(key) < min_points or _points(key) < min_points or _halves(key)[0] not in drop:
                        kept.append(x)
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode())
            else:
                n_dropped.append(0)
                texts.append(text or "")
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    if alone:
        joined = own.join(lost, ["doc_id", "mark"], "left")
    else:
        copies = own.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
        joined = spread_join(own, stored(copies.join(lost, ["doc_id", "mark"]), "lost"), ["doc_id", "mark"], "n", rows, "left")
    return map_slices(joined.select("doc_id", "text", "lost"), "text", rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def digest(deduped: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))

