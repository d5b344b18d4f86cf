"""Append-only event tables: partitioned, sorted zstd Parquet, read by window and keys.

A record has a time, text keys, a raw payload and nullable typed fields. It lies in
the partition of its partition key's value and of its time's slot. Tables grow by
nullable fields at the end only; older parts read those as nulls.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import content_token, partition_id, record_digest, time_slot, value_bytes

KINDS = {"bool": T.BooleanType(), "int": T.LongType(), "uint": T.DecimalType(20, 0), "text": T.StringType(), "bytes": T.BinaryType()}
#: Parts of a partition whose tokens an append is held against.
RECENT_PARTS = 16


class EventError(ValueError):
    """A table, query or batch that is not allowed, or a budget overrun."""


@dataclass(frozen=True)
class EventTable:
    time: str
    keys: tuple[str, ...]
    width: int
    partition_key: str | None = None
    sort: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    raw: str = "raw"

    def __post_init__(self) -> None:
        names = [self.time, *self.keys, self.raw, *(n for n, _ in self.fields)]
        if len(set(names)) != len(names) or not all(names):
            raise EventError("columns must have names of their own")
        if self.width <= 0 or {*self.sort, *([self.partition_key] if self.partition_key else [])} - set(self.keys):
            raise EventError("width must be positive, sort and partition keys must be keys")
        if any(k not in KINDS for _, k in self.fields):
            raise EventError("a field has no such kind")

    def kind(self, name: str) -> str:
        if name == self.time:
            return "int"
        if name in self.keys:
            return "text"
        if name == self.raw:
            return "bytes"
        found = dict(self.fields).get(name)
        if found is None:
            raise EventError(f"no column {name!r}")
        return found

    @property
    def columns(self) -> list[str]:
        return [self.time, *self.keys, self.raw, *(n for n, _ in self.fields)]

    def struct(self, partitions: bool = False) -> T.StructType:
        own = [T.StructField(c, KINDS[self.kind(c)], c in dict(self.fields)) for c in self.columns]
        parts = [T.StructField("p_key", T.StringType()), T.StructField("p_slot", T.LongType())]
        return T.StructType([*own, *(parts if partitions else [])])

    def evolved(self, fields: Sequence[tuple[str, str]]) -> EventTable:
        """The table with all its fields and further ones at the end."""
        fields = tuple(fields)
        if fields[: len(self.fields)] != self.fields:
            raise EventError("fields may only be added at the end")
        return replace(self, fields=fields)

    def slot(self) -> Column:
        return time_slot(self.time, self.width)

    def part_key(self) -> Column:
        """The partition key's value as it names a directory; an empty value is not an absent one."""
        if self.partition_key is None:
            return F.lit("n")
        return F.concat(F.lit("k"), F.lower(F.hex(F.encode(F.col(self.partition_key), "UTF-8"))))

    def partition(self) -> Column:
        return partition_id(F.col(self.partition_key) if self.partition_key else None, self.slot())


@dataclass(frozen=True)
class EventQuery:
    """A half-open window and equalities on keys; ``columns`` are given in their order."""

    start: int | None = None
    stop: int | None = None
    equals: Mapping[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Budget:
    """The default limits of one query."""

    candidates: int = 10_000_000
    rows: int = 1_000_000
    bytes: int = 256 << 20


# ---- writing ----------------------------------------------------------------

def checked(table: EventTable, batch: DataFrame) -> DataFrame:
    """The batch in the table's columns; absent fields become nulls, absent times, keys or payloads are errors at run time."""
    have = set(batch.columns)
    missing = {table.time, *table.keys, table.raw} - have
    if missing:
        raise EventError(f"the batch lacks {sorted(missing)}")
    columns = [F.col(c) if c in have else F.lit(None).cast(KINDS[table.kind(c)]) for c in table.columns]
    rows = batch.select(*(c.cast(KINDS[table.kind(n)]).alias(n) for c, n in zip(columns, table.columns, strict=True)))
    needed = [F.col(table.time) >= 0, *(F.col(c).isNotNull() for c in (table.time, *table.keys, table.raw))]
    sound = reduce(lambda a, b: a & b, needed)
    return rows.withColumn(table.time, F.when(sound, F.col(table.time)).otherwise(F.raise_error(F.lit("a record lacks its time, a key or its payload")).cast("long")))


def write(table: EventTable, batch: DataFrame, path: str, rows_a_file: int = 5_000_000) -> None:
    """Append a batch as sorted parts.

    Rows are dealt by ranges of (partition, sort keys, time): a partition with
    most of the rows spreads over many tasks, and each file covers a short range
    of keys and times, so footers and blooms prune it.
    """
    order = [*table.sort, table.time]
    rows = checked(table, batch).withColumn("p_key", table.part_key()).withColumn("p_slot", table.slot())
    dealt = rows.repartitionByRange("p_key", "p_slot", *order).sortWithinPartitions("p_key", "p_slot", *order)
    writer = dealt.write.mode("append").partitionBy("p_key", "p_slot").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("maxRecordsPerFile", rows_a_file)
    writer = writer.option("parquet.writer.version", "v2")
    for key in table.keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.enable.dictionary#{key}", "false")
    writer.parquet(path)


def read(spark: SparkSession, table: EventTable, path: str) -> DataFrame:
    """All records, under the table's present fields."""
    return spark.read.schema(table.struct(partitions=True)).parquet(path)


def union(sealed: DataFrame, open_: DataFrame) -> DataFrame:
    """Sealed parts and open records of one version."""
    return sealed.unionByName(open_, allowMissingColumns=True)


def as_stored(table: EventTable, batch: DataFrame) -> DataFrame:
    """A batch as reading it back would give it, for open records."""
    return checked(table, batch).withColumn("p_key", table.part_key()).withColumn("p_slot", table.slot())


# ---- queries ----------------------------------------------------------------

def matched(table: EventTable, rows: DataFrame, query: EventQuery) -> DataFrame:
    """The records of a window with these keys.

    The window's slots and an equality on the partition key also become filters
    on the partition columns, which the source prunes directories by.
    """
    at = F.col(table.time)
    has_parts = {"p_key", "p_slot"} <= set(rows.columns)
    if query.start is not None:
        rows = rows.filter(at >= query.start)
        if has_parts:
            rows = rows.filter(F.col("p_slot") >= query.start // table.width)
    if query.stop is not None:
        rows = rows.filter(at < query.stop)
        if has_parts:
            rows = rows.filter(F.col("p_slot") <= (query.stop - 1) // table.width)
    for name, value in query.equals.items():
        if name not in table.keys:
            raise EventError(f"{name!r} is no key")
        rows = rows.filter(F.col(name) == value)
        if has_parts and name == table.partition_key:
            rows = rows.filter(F.col("p_key") == "k" + value.encode().hex())
    return rows


def projected(table: EventTable, rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = list(table.columns if columns is None else columns)
    if not names or len(set(names)) != len(names):
        raise EventError("a projection needs distinct columns")
    for name in names:
        table.kind(name)
    return rows.select(*names)


def select(table: EventTable, rows: DataFrame, query: EventQuery) -> DataFrame:
    return projected(table, matched(table, rows, query), query.columns)


def payloads(table: EventTable, rows: DataFrame, query: EventQuery) -> DataFrame:
    return matched(table, rows, query).select(table.raw)


def count(table: EventTable, rows: DataFrame, query: EventQuery) -> DataFrame:
    """The number of matching records; no data column is read for it beyond the filters'."""
    return matched(table, rows, query).agg(F.count("*").alias("count"))


def of_source(table: EventTable, rows: DataFrame, query: EventQuery, axis: str, source: str, allowed: bool) -> DataFrame:
    """A query whose ``axis`` key is forced to one source, after the check of its grant."""
    if not allowed:
        raise EventError(f"no grant on {source!r}")
    return select(table, rows, replace(query, equals={**query.equals, axis: source}))


def observed(table: EventTable, rows: DataFrame, query: EventQuery, name: str = "events") -> tuple[DataFrame, Observation]:
    """A query with its statistics: matched rows and charged bytes, known once an action has run."""
    found = select(table, rows, query)
    size = reduce(lambda a, b: a + b, [value_bytes(F.col(c), table.kind(c)) for c in found.columns])
    seen = Observation(name)
    return found.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen


def statistics(table: EventTable, rows: DataFrame, query: EventQuery) -> DataFrame:
    """(partitions, candidates, rows, bytes) of a query over stored parts.

    Candidates are the records of the partitions and slots that the query reads;
    of these the rows match. Bytes are charged for the columns given.
    """
    parts = ("p_key", "p_slot")
    found = rows
    if query.start is not None:
        found = found.filter(F.col("p_slot") >= query.start // table.width)
    if query.stop is not None:
        found = found.filter(F.col("p_slot") <= (query.stop - 1) // table.width)
    own = query.equals.get(table.partition_key) if table.partition_key else None
    if own is not None:
        found = found.filter(F.col("p_key") == "k" + own.encode().hex())
    at, fits = F.col(table.time), F.lit(True)
    if query.start is not None:
        fits = fits & (at >= query.start)
    if query.stop is not None:
        fits = fits & (at < query.stop)
    for name, value in query.equals.items():
        fits = fits & (F.col(name) == value)
    size = reduce(lambda a, b: a + b, [value_bytes(F.col(c), table.kind(c)) for c in query.columns or table.columns])
    counts = [F.count("*").alias("candidates"), F.count_if(fits).alias("rows"), F.coalesce(F.sum(F.when(fits, size)), F.lit(0)).alias("bytes")]
    return found.groupBy(*parts).agg(*counts).agg(F.count("*").alias("partitions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "rows", "bytes")))


def within(table: EventTable, rows: DataFrame, query: EventQuery, budget: Budget = Budget()) -> DataFrame:
    """A query refused if it would pass its budget; counting stops one row beyond each limit."""
    slots = matched(table, rows, replace(query, equals={}))
    if slots.limit(budget.candidates + 1).count() > budget.candidates:
        raise EventError(f"more than {budget.candidates} candidates")
    found = select(table, rows, query)
    size = reduce(lambda a, b: a + b, [value_bytes(F.col(c), table.kind(c)) for c in found.columns])
    used = found.limit(budget.rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if used["n"] > budget.rows:
        raise EventError(f"more than {budget.rows} rows")
    if used["b"] > budget.bytes:
        raise EventError(f"more than {budget.bytes} bytes")
    return found


def batches(found: DataFrame, size: int = 1024) -> Iterator[list[Row]]:
    """A query's rows in lists of at most ``size``, one partition fetched at a time."""
    if not 1 <= size <= 65_536:
        raise EventError("a batch has 1 to 65536 rows")
    rows = found.toLocalIterator(prefetchPartitions=True)
    while some := list(islice(rows, size)):
        yield some


def summary(table: EventTable, rows: DataFrame) -> DataFrame:
    """(partition, since, until, rows) of each partition; ``until`` is exclusive."""
    at = F.col(table.time)
    return rows.groupBy(table.partition().alias("partition")).agg(F.min(at).alias("since"), (F.max(at) + 1).alias("until"), F.count("*").alias("rows"))


# ---- life -------------------------------------------------------------------

def retained(rows: DataFrame, table: EventTable, floor: int) -> DataFrame:
    """The records of slots from ``floor`` on. Later writes below it are not refused."""
    slot_no = F.col("p_slot") if "p_slot" in rows.columns else table.slot()
    return rows.filter(slot_no >= floor)


def batch_tokens(table: EventTable, batches: DataFrame, operator: str, token: str, position: str, by: list[str]) -> DataFrame:
    """(by, content_token): a name for the content of each batch, the rows of ``batches`` with equal ``by``.

    Batches have one name only if operator, token and, record for record in the
    order of ``position``, time, keys and payload are the same. A record counts by
    its digest, so a batch's row stays small.
    """
    rows = batches.withColumn("record", record_digest(F.col(table.time), [F.col(k) for k in table.keys], F.col(table.raw)))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), "record")))
    found = rows.groupBy(*by, operator, token).agg(ordered.alias("records"))
    return found.select(*by, content_token(F.col(operator), F.col(token), F.transform("records", lambda r: r["record"])).alias("content_token"))


def unseen(batch: DataFrame, ledger: DataFrame, recent: int = RECENT_PARTS) -> DataFrame:
    """The records of ``batch`` (partition, token, ...) whose token their partition has not seen.

    ``ledger`` is (partition, token, part), part None while open. Only the open
    part and the last ``recent`` sealed parts of a partition are looked at.
    """
    parts = ledger.filter(F.col("part").isNotNull()).select("partition", "part").distinct()
    rank = F.row_number().over(W.partitionBy("partition").orderBy(F.col("part").desc()))
    late = parts.withColumn("rank", rank).filter(F.col("rank") <= recent).select("partition", "part")
    seen = ledger.filter(F.col("part").isNull()).select("partition", "token").union(ledger.join(late, ["partition", "part"], "left_semi").select("partition", "token"))
    return batch.join(seen.distinct(), ["partition", "token"], "left_anti")


def misplaced(table: EventTable, rows: DataFrame) -> DataFrame:
    """(partition, rows): records that do not lie in the partition that their key and time demand."""
    wrong = ~table.part_key().eqNullSafe(F.col("p_key")) | ~table.slot().eqNullSafe(F.col("p_slot"))
    return rows.filter(wrong).groupBy(table.partition().alias("partition")).agg(F.count("*").alias("rows"))


def adoptable(spark: SparkSession, table: EventTable, path: str) -> bool:
    """Whether files found at ``path`` can become the table: a prefix of its columns, every record in its place."""
    found = [(c.name, c.dataType) for c in spark.read.parquet(path).schema if c.name not in ("p_key", "p_slot")]
    own = [(c.name, c.dataType) for c in table.struct()]
    return found == own[: len(found)] and len(found) >= 2 + len(table.keys) and misplaced(table, read(spark, table, path)).isEmpty()
