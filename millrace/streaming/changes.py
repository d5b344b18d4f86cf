"""The change log: appending, windows, visibility, and tailing it as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import numbered
from ..operators.policy import Grant, Principal, broad, visible
from ..operators.world import World
from ..sources.events import RECENT_PARTS

#: Fixed value: entries that the log keeps.
WINDOW = 4_096
LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("verb", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("key", T.LongType()), T.StructField("who", T.StringType())])


class CursorError(ValueError):
    """A cursor that the log no longer reaches back to."""


def appended(log: DataFrame, changes: DataFrame, who: str, last: int) -> DataFrame:
    """The log with a batch's changes (verb, unit, key) as entries from ``last + 1`` on."""
    fresh = numbered(changes.select("verb", "unit", "key"), ["unit", "verb", "key"], last + 1).withColumn("who", F.lit(who))
    return log.unionByName(fresh.select(*log.columns))


def kept(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """The newest ``window`` entries; the newest id is one row fetched beforehand, so the scan is filtered."""
    last = log.agg(F.max("id")).first()[0]
    return log if last is None else log.filter(F.col("id") > last - window)


def after(log: DataFrame, cursor: int, window: int = WINDOW) -> DataFrame:
    """The entries after a cursor, in order; an error if entries after it are gone."""
    last = log.agg(F.max("id")).first()[0] or 0
    if cursor < last - window:
        raise CursorError(f"entries after {cursor} have left the window")
    return log.filter(F.col("id") > cursor).orderBy("id")


def heard(world: World, log: DataFrame, grants: Sequence[Grant], who: Principal) -> DataFrame:
    """The entries that a principal may see.

    An entry of a live row needs a grant on the row, one of a dead row a grant on
    all rows of its entity; entries of edges go by their live edge's left row.
    """
    if who.sudo:
        return log
    parts = []
    for e in world.schema.entities:
        wide = broad(world, e.name, grants, who)
        own = log.filter(F.col("unit") == e.name)
        live_ids = world.rows(e.name).select("id")
        seen = visible(world, e.name, live_ids, grants, who).select(F.col("id").alias("key"))
        parts.append(own.join(seen, "key", "left_semi"))
        if wide:
            parts.append(own.join(live_ids.select(F.col("id").alias("key")), "key", "left_anti"))
        for r in e.relations:
            name = f"{e.name}.{r.name}"
            if name not in world.edges:
                continue
            entries = log.filter(F.col("unit") == name)
            edges = world.relation(e.name, r.name).select(F.col("id").alias("key"), F.col("left").alias("id"))
            held = visible(world, e.name, edges, grants, who).select("key")
            parts.append(entries.join(held, "key", "left_semi"))
            if wide:
                parts.append(entries.join(edges.select("key"), "key", "left_anti"))
    return reduce(DataFrame.unionByName, [p.select(*log.columns) for p in parts])


# ---- streams ----------------------------------------------------------------

def tail(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The log's Parquet files as a stream; a checkpoint keeps the place."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, units: Sequence[str] = (), verbs: Sequence[str] = (), see: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Send entries of some units and verbs to ``sink(batch, number)``, at least once.

    ``see`` filters a batch by what its receiver may see at that time. A sink that
    keeps the batch's number delivers each batch once.
    """
    rows = stream
    if units:
        rows = rows.filter(F.col("unit").isin(*units))
    if verbs:
        rows = rows.filter(F.col("verb").isin(*verbs))

    def send(batch: DataFrame, number: int) -> None:
        sink(see(batch) if see else batch, number)

    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_once(stream: DataFrame, path: str, ledger: str, checkpoint: str, token: Sequence[str], recent: int = RECENT_PARTS, **trigger) -> StreamingQuery:
    """Append a stream's rows to a table, each batch once, and no row whose token the last ``recent`` batches had.

    A batch's rows and tokens are written under its number, so a batch that runs
    again after a crash replaces its own files. Of rows with one token the
    smallest is kept.
    """
    session = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        named = batch.select(F.struct("*").alias("own"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in token)), 256).alias("token"))
        named = named.groupBy("token").agg(F.min("own").alias("own"))
        # the batch number is a directory: older ones aren't read
        seen = session.read.schema("token string, batch long").parquet(ledger).filter((F.col("batch") < number) & (F.col("batch") >= number - recent)).select("token")
        fresh = named.join(seen, "token", "left_anti").persist()
        fresh.select("own.*").write.mode("overwrite").parquet(f"{path}/batch={number}")
        fresh.select("token").write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        fresh.unpersist()

    session.createDataFrame([], "token string").write.mode("overwrite").parquet(f"{ledger}/batch=-1")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def acknowledged(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """The outbox without the acknowledged (entity, field, key) entries; the others are delivered again."""
    marked = acks.select(*(F.col(c).alias(f"ack_{c}") for c in ("entity", "field", "key")))
    same = reduce(lambda a, b: a & b, [outbox[c].eqNullSafe(marked[f"ack_{c}"]) for c in ("entity", "field", "key")])
    return outbox.join(marked, same, "left_anti")
