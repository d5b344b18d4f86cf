"""Shared pieces of the text operators: Arrow batches, word hashing, storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import HOT_KEYS
from ..functions.session import fresh_path, shared_dir

#: Text bytes handled at once inside a task; a longer text forms a slice alone.
SLICE_BYTES = 1 << 20
#: Rows of one key that a task may meet, at least.
HOT_ROWS = 256


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def map_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over ``df`` in slices bounded by the bytes of column ``text``."""

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            for at, to in slices(column):
                yield fn(batch.slice(at, to - at))

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, keeps: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of ``df`` whose text ``keeps`` accepts, with all columns, in the pass that reads them: nothing is shuffled."""
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(place)):
                own = batch.slice(at, to - at)
                yield own.filter(pa.array(keeps(own.column(place)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and each text's offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_SEED = np.random.default_rng(20_240_229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, from one rolling sum."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross texts, and each text's first run."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= ~member[:-1]
    stops[:-1] |= ~member[1:]
    starts = np.flatnonzero(member & begins)
    ends = np.flatnonzero(member & stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's first word.

    A word is a run of ASCII letters and digits and of any non-ASCII characters.
    """
    data, offsets = raw(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, first = runs(_LETTER[data], offsets)
    return span_hashes(data, starts, ends), first


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``[^\\x20\\x09-\\x0D]``: starts, ends and each text's first word."""
    return runs(~_BLANK[data], offsets)


def window_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the word each starts at."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(words) - n + 1
    value = np.zeros(total, np.uint64)
    for k in range(n):
        value = value * _BASE + words[k : k + total]
    fits = np.ones(total, bool)
    for k in range(1, n):  # windows that begin in the last n-1 words of a text run over its end
        at = first[1:] - k
        at = at[(at >= 0) & (at >= first[:-1]) & (at < total)]
        fits[at] = False
    at = np.flatnonzero(fits)
    return mix(value[at]), at


def unused(df: DataFrame, name: str) -> str:
    """``name``, changed until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has a row a key and the number ``n`` of the key's rows; inner or left.

    ``total`` is at least the number of all rows, so fewer than ``HOT_KEYS`` keys
    hold more than ``total / HOT_KEYS`` rows each: their facts are broadcast. The
    others are shuffled, and no key brings many rows to one task, nor do rows
    without a key, which have no facts.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    mark = unused(rows, "is_hot")
    tagged = rows.join(F.broadcast(facts.filter(F.col(n) > most).withColumn(mark, F.lit(True))), on, "left")
    none = F.greatest(*(F.col(c).isNull() for c in on)) if len(on) > 1 else F.col(on[0]).isNull()
    done = F.col(mark).isNotNull() | (none if how == "left" else F.lit(False))
    hot = tagged.filter(done).drop(mark)
    rest = tagged.filter(~done).select(*rows.columns)
    return hot.unionByName(rest.join(facts.filter(F.col(n) <= most), on, how))


def clean_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with a null id replaced by the smallest long: such rows form one document."""
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
