"""Token ids in bit-plane or byte-plane files.

A file holds the ids of a run of documents in ascending id order. Its ids are
cut into blocks of a fixed number; each block is transposed into planes (all
lowest bytes, then all next bytes, ...; or the same by bits), each plane is
compressed with zstandard, and an index at the end of the file has every
plane's place, so that a block is read without the others.

    "MRT1" | planes ... | index (int64s, zstandard) | footer (index place, size)

The index lists block by block: ids in it, planes, and each plane's place and
size; then the documents' ids and lengths. Files travel as the binary column of
a table that Spark writes and reads, so that any store Spark knows holds them;
``export`` writes them as files of their own.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import tempfile
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored

MAGIC = b"MRT1"
BLOCK_IDS = 65_536
#: Ids after which a task begins the next file.
FILE_IDS = 2_000_000
END_ID = 2
LEVEL = 3
FILES = "part int, seq int, n_ids long, n_docs long, content binary"
#: Bytes of pieces and ids that a Python worker keeps; and characters of a piece that is kept.
CACHE_BYTES, CACHE_PIECE = 128 << 20, 64


# ---- planes -----------------------------------------------------------------

def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first, without empty top planes."""
    used = max(1, int(ids.max(initial=0)).bit_length())
    if kind == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
        return [np.ascontiguousarray(rows[k]).tobytes() for k in range(-(-used // 8))]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(used)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if kind == "byte":
            ids |= np.frombuffer(plane, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


def write_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK_IDS, kind: str = "byte") -> bytes:
    """One file: ``ids`` of documents ``doc_ids`` with ``lengths`` ids each."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    out, at, index = [MAGIC], len(MAGIC), [1 if kind == "bit" else 0, -(-len(ids) // block)]
    for k in range(0, len(ids), block):
        planes = to_planes(ids[k : k + block], kind)
        index += [min(block, len(ids) - k), len(planes)]
        for plane in planes:
            packed = squeeze.compress(plane)
            index += [at, len(packed)]
            out.append(packed)
            at += len(packed)
    index += [len(doc_ids), *doc_ids.tolist(), *lengths.tolist()]
    packed = squeeze.compress(np.array(index, "<i8").tobytes())
    return b"".join([*out, packed, struct.pack("<qq", at, len(packed)), MAGIC])


class File:
    """A file's index, and its blocks on demand."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC or content[-4:] != MAGIC:
            raise ValueError("not a token file")
        at, n = struct.unpack("<qq", content[-20:-4])
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[at : at + n]), "<i8")
        self._content, self.kind = content, "bit" if index[0] else "byte"
        self.blocks, k = [], 2
        for _ in range(index[1]):
            n_planes = int(index[k + 1])
            self.blocks.append((int(index[k]), index[k + 2 : k + 2 + 2 * n_planes].reshape(-1, 2)))
            k += 2 + 2 * n_planes
        n_docs = int(index[k])
        self.doc_ids = index[k + 1 : k + 1 + n_docs]
        self.lengths = index[k + 1 + n_docs : k + 1 + 2 * n_docs]

    def block(self, k: int) -> np.ndarray:
        n, places = self.blocks[k]
        expand = zstandard.ZstdDecompressor()
        return from_planes([expand.decompress(self._content[a : a + size]) for a, size in places], n, self.kind)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.block(k) for k in range(len(self.blocks)))])


# ---- encoding ---------------------------------------------------------------

class _Pieces(dict):
    """The ids of a piece of text, found once; pieces are named without what stands before them."""

    #: Signs that part from a letter before them and hold together among themselves.
    SIGNS = ".,!?;:#$%&*"

    def __init__(self, encode, before: str):
        super().__init__()
        self._encode, self._before, self._signs, self._held = encode, before, {}, 0  # encode: ids of a text

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(self.SIGNS)
        if core and len(core) < len(piece) and core[-1].isalpha():
            signs = piece[len(core) :]
            ends = self._signs.get(signs)
            if ends is None:
                ends = self._encode(signs)
                if len(signs) <= CACHE_PIECE:
                    self._signs[signs] = ends
                    self._held += 200
            found = self[core] + ends
        else:
            found = self._encode(self._before + piece)
        if len(piece) <= CACHE_PIECE:  # a text without blanks is one piece
            self[piece] = found
            self._held += 150 + len(piece) + len(found)  # with what Python adds to both
        return found

    def trim(self) -> None:
        if self._held > CACHE_BYTES:
            self.clear()
            self._signs.clear()
            self._held = 0


class _Letters(dict):
    """What a byte-level pre-tokenizer writes for a character, by its code point."""

    def __init__(self, split):
        super().__init__()
        self._split = split

    def __missing__(self, point: int) -> str:
        self[point] = found = "".join(part for part, _ in self._split(chr(point)))
        return found


class Encoder:
    """A byte-level tokenizer of the ``tokenizers`` library with a cache of words.

    Such a tokenizer never merges over the start of a blank that follows a
    non-blank, nor over the place where signs follow a letter, so a text's ids
    are those of the pieces cut there, and each distinct piece is encoded once.
    """

    _CUT = re.compile(r"(?<=\S) ")
    _ODD = re.compile(r"\s ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        model, plain = tokenizer.model, tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel)
        letters = _Letters(tokenizer.pre_tokenizer.pre_tokenize_str) if plain else None

        def encode(text: str) -> bytes:
            word = text[1:] if text[:1] == " " else text
            if plain and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                # one word: the model alone is asked, without the rest of the library's work on a text
                ids = array("I", [t.id for t in model.tokenize(text.translate(letters))])
            else:
                ids = array("I", tokenizer.encode(text, add_special_tokens=False).ids)
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()

        self._heads, self._rest = _Pieces(encode, ""), _Pieces(encode, " ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self._heads.trim()
        self._rest.trim()
        out, known = [], self._rest.__getitem__
        for text in texts:
            pieces = self._CUT.split(text) if self._ODD.search(text) else text.split(" ")
            head = self._heads[pieces[0]]
            out.append(head + b"".join(map(known, pieces[1:])))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- the job ----------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK_IDS, kind: str = "byte", file_ids: int = FILE_IDS, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Token files of all documents, in the order of the columns ``order`` over (part, seq); by default in ascending id order.

    Null texts are empty and hold the end id alone; null ids come first; rows of
    one id follow each other by their text, and the text's beginning deals them to
    tasks. An empty table gives no file; further columns are not looked at.
    """

    def run(batches):
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        seq, held, ids, size = 0, [], [], 0

        def flush():
            nonlocal seq, held, ids, size
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            content = write_file(np.frombuffer(b"".join(held), "<u4"), np.array(ids, np.int64), lengths, block, kind)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size]), pa.array([len(ids)]), pa.array([content], pa.binary())], names=["part", "seq", "n_ids", "n_docs", "content"])
            seq, held, ids, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            for at, to in slices(batch.column(1)):
                own = batch.slice(at, to - at)
                for i, found in zip(own.column(0).to_pylist(), encode([t or "" for t in own.column(1).to_pylist()]), strict=True):
                    held.append(found + end)
                    ids.append(-(2**63) if i is None else i)
                    size += len(found) // 4 + 1
                    if size >= file_ids:
                        yield flush()
        if ids:
            yield flush()

    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    keys = [c if isinstance(c, Column) else F.col(c) for c in order or ()]
    if keys:
        ranged = docs.select(*own, *(k.alias(f"order_{i}") for i, k in enumerate(keys)))
        names = [f"order_{i}" for i in range(len(keys))]
        ranged = ranged.repartitionByRange(*names).sortWithinPartitions(*names, "doc_id", "text").select("doc_id", "text")
    else:
        ranged = docs.select(*own).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(run, FILES), "tokens", compression="uncompressed")


def export(files: DataFrame, folder: str) -> DataFrame:
    """The files written one by one below ``folder``, which tasks reach as a path: (part, seq, path, size).

    For mounted stores; a file is moved into place whole, so that a repeated task does no harm.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for part, seq, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, f"{part:05d}-{seq:05d}.mrt")
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                    f.write(content)
                os.replace(f.name, path)
                rows.append((part, seq, path, len(content)))
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "size"), r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("size", pa.int64())]))

    return files.select("part", "seq", "content").mapInArrow(run, "part int, seq int, path string, size long")


def read_documents(files: DataFrame) -> DataFrame:
    """(part, seq, doc_id, at, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches):
        for batch in batches:
            for part, seq, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = File(content)
                ids, ends = f.ids().astype("<u4"), np.cumsum(f.lengths)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), f.lengths.tolist(), strict=True)]
                n = len(sums)
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(f.doc_ids), pa.array(ends - f.lengths), pa.array(f.lengths), pa.array(sums, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.select("part", "seq", "content").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")


def digest(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("within", within).join(parts.withColumn("before", before).drop("n"), "part")
    docs = read_documents(files).join(places.drop("n_ids"), ["part", "seq"])
    doc_id = F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id"))
    return docs.select(doc_id.alias("doc_id"), (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
