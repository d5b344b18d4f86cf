"""Closures, owner chains, cascades and retention over relations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import live, unexpired
from .world import DEPTH, World


class GraphError(ValueError):
    """A graph too deep, or an edge that would close a cycle."""


def shared(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint where the session has a folder for one."""
    context = df.sparkSession.sparkContext
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (root, reach) pairs with root <> reach along edges (left, right).

    Paths double in each round, so a graph of depth d takes log2(d) joins.
    """
    pairs = edges.filter("left <> right").select(F.col("left").alias("root"), F.col("right").alias("reach")).distinct()
    pairs = shared(pairs)
    size = pairs.count()
    for _ in range(rounds):
        ahead = pairs.select(F.col("root").alias("reach"), F.col("reach").alias("next"))
        longer = pairs.join(ahead, "reach").select("root", F.col("next").alias("reach")).filter("root <> reach")
        grown = shared(pairs.union(longer).distinct())
        now = grown.count()
        if now == size:
            return grown
        pairs, size = grown, now
    raise GraphError("the closure did not settle")


def closure_changes(before: DataFrame, edges: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """The kept closure edges with their ids and the new ones, and the ended ones.

    ``before`` has (id, left, right); pairs that stay reachable keep their ids.
    """
    now = closure(edges).select(F.col("root").alias("left"), F.col("reach").alias("right"))
    kept = before.join(now, ["left", "right"], "left_semi")
    ended = before.join(now, ["left", "right"], "left_anti")
    fresh = now.join(before, ["left", "right"], "left_anti")
    return kept.select("id", "left", "right").unionByName(numbered(fresh, ["left", "right"], next_id)), ended


def numbered(rows: DataFrame, order: list[str | Column], first: int, name: str = "id") -> DataFrame:
    """``rows`` with numbers from ``first`` on, in a column ``name``, in the given order, without gathering them in one task.

    Rows are range-partitioned; each partition counts from where the ones before
    it end. The counts are one small row a partition.
    """
    ranged = shared(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("low")).orderBy("part").collect()
    starts, at = [], first
    for c in counts:
        starts.append((c["part"], at - c["low"]))
        at += c["n"]
    if not starts:
        return ranged.select(F.lit(0).cast("long").alias(name), *rows.columns)
    shift = ranged.sparkSession.createDataFrame(starts, "part int, shift long")
    return ranged.join(F.broadcast(shift), "part").select((F.col("nth") + F.col("shift")).alias(name), *rows.columns)


def closes_cycle(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``edges`` (left, right) that a closure relation refuses: loops, and those whose right reaches their left."""
    back = reach.select(F.col("root").alias("right"), F.col("reach").alias("left"))
    return edges.filter("left = right").unionByName(edges.filter("left <> right").join(back, ["left", "right"], "left_semi"))


# ---- owners -----------------------------------------------------------------

def owner_chain(world: World, entity: str) -> DataFrame:
    """(id, hop, entity, key): each live row, its owner, that one's owner, up to ``DEPTH`` hops.

    Dead owners end the chain.
    """
    own = world.schema.entity(entity)
    at = world.rows(own.name).select("id", F.col("id").alias("key"), *([F.col(own.owner.column).alias("up")] if own.owner else []))
    hops = [at.select("id", F.lit(0).alias("hop"), F.lit(own.name).alias("entity"), "key")]
    for hop in range(1, DEPTH + 1):
        if not own.owner:
            break
        own = world.schema.entity(own.owner.target)
        up = world.rows(own.name).select(F.col("id").alias("up"), *([F.col(own.owner.column).alias("next")] if own.owner else []))
        at = at.join(up, "up").select("id", F.col("up").alias("key"), *([F.col("next").alias("up")] if own.owner else []))
        hops.append(at.select("id", F.lit(hop).alias("hop"), F.lit(own.name).alias("entity"), "key"))
    return reduce(DataFrame.unionByName, hops)


def frontier(world: World, entity: str, keys: DataFrame, at: int | None = None) -> DataFrame:
    """(entity, layer, key): rows ``keys`` (id) and all that they own, layer by layer, live at ``at``.

    One join a layer and child entity, whatever the number of rows; an owner that
    owns itself goes on for ``DEPTH`` layers at most.
    """
    at = world.now if at is None else at
    root = world.schema.entity(entity)
    begin = world.history(root.name).filter(live(at)).join(keys.select("id"), "id", "left_semi")
    layers = [begin.select(F.lit(root.name).alias("entity"), F.lit(0).alias("layer"), F.col("id").alias("key"))]
    open_ = {root.name: layers[0]}
    for layer in range(1, DEPTH + 1):
        found: dict[str, DataFrame] = {}
        for child, reference in world.parents():
            above = open_.get(reference.target)
            if above is None:
                continue
            held = above.select(F.col("key").alias(reference.column))
            below = world.history(child.name).filter(live(at)).join(held, reference.column, "left_semi")
            rows = below.select(F.lit(child.name).alias("entity"), F.lit(layer).alias("layer"), F.col("id").alias("key"))
            found[child.name] = rows if child.name not in found else found[child.name].unionByName(rows)
        if any(r.target == c.name for c, r in world.parents()):  # self-owned entities may end early
            found = {name: rows for name, rows in ((n, shared(r)) for n, r in found.items()) if not rows.isEmpty()}
        if not found:
            break
        layers += found.values()
        open_ = found
    return reduce(DataFrame.unionByName, layers)


def frontier_counts(reached: DataFrame) -> DataFrame:
    return reached.groupBy("entity").agg(F.countDistinct("key").alias("keys"))


def blocking_holders(world: World, reached: DataFrame, at: int | None = None) -> DataFrame:
    """(holder, name, key, target): rows and edges outside the frontier that still point into it at ``at``.

    An edge whose own left row is dead holds nothing.
    """
    at = world.now if at is None else at
    out = []
    for holder in world.schema.entities:
        inside = reached.filter(F.col("entity") == holder.name).select(F.col("key").alias("id"))
        outside = world.history(holder.name).filter(live(at)).join(inside, "id", "left_anti")
        for reference in holder.references:
            ends = reached.filter(F.col("entity") == reference.target).select(F.col("key").alias(reference.column))
            found = outside.join(ends, reference.column, "left_semi")
            out.append(found.select(F.lit(holder.name).alias("holder"), F.lit(reference.name).alias("name"), F.col("id").alias("key"), F.col(reference.column).alias("target")))
        for relation in holder.relations:
            name = f"{holder.name}.{relation.name}"
            if name not in world.edges:
                continue
            ends = reached.filter(F.col("entity") == relation.target).select(F.col("key").alias("right"))
            edges = world.edges[name].filter(live(at)).join(ends, "right", "left_semi")
            found = edges.join(outside.select(F.col("id").alias("left")), "left", "left_semi")
            out.append(found.select(F.lit(holder.name).alias("holder"), F.lit(relation.name).alias("name"), F.col("id").alias("key"), F.col("right").alias("target")))
    return reduce(DataFrame.unionByName, out)


def retired(world: World, reached: DataFrame, entity: str, at: int, now: int) -> DataFrame:
    """The entity's rows, those of the frontier ended at ``at``."""
    keys = reached.filter(F.col("entity") == entity).select(F.col("key").alias("id"), F.lit(True).alias("falls")).distinct()
    rows = world.history(entity).join(keys, "id", "left")
    ends = F.col("falls").isNotNull() & live(at)
    columns = world.history(entity).columns
    return rows.withColumn("updated_at", F.when(ends, F.lit(now).cast("long")).otherwise(F.col("updated_at"))).withColumn("expires_at", F.when(ends, F.lit(at).cast("long")).otherwise(F.col("expires_at"))).select(*columns)


def cascade(world: World, entity: str, keys: DataFrame, at: int | None = None) -> dict[str, DataFrame]:
    """The tables after rows ``keys`` and all they own have ended; refused while others hold them."""
    at = world.now if at is None else at
    reached = shared(frontier(world, entity, keys, at))
    if not blocking_holders(world, reached, at).isEmpty():
        raise GraphError("rows outside still hold rows that would end")
    names = [r["entity"] for r in reached.select("entity").distinct().collect()]  # names of the schema
    return {name: retired(world, reached, name, at, world.now) for name in names}


# ---- retention --------------------------------------------------------------

def collectable_rows(world: World, entity: str, cutoff: int, batch: int | None = None) -> DataFrame:
    """Ids of rows ended by ``cutoff`` to which no live reference and no edge points, and which have no edges."""
    own = world.schema.entity(entity)
    rows = world.history(own.name).filter(F.col("expires_at") <= cutoff).select("id")
    for holder in world.schema.entities:
        for reference in holder.references:
            if reference.target == own.name:
                held = world.rows(holder.name).select(F.col(reference.column).alias("id"))
                rows = rows.join(held, "id", "left_anti")
        for relation in holder.relations:
            edges = world.edges.get(f"{holder.name}.{relation.name}")
            if edges is None:
                continue
            if relation.target == own.name:
                rows = rows.join(edges.select(F.col("right").alias("id")), "id", "left_anti")
            if holder.name == own.name:
                rows = rows.join(edges.select(F.col("left").alias("id")), "id", "left_anti")
    return rows if batch is None else rows.orderBy("id").limit(batch)


def collectable_edges(world: World, entity: str, relation: str, cutoff: int, batch: int | None = None) -> DataFrame:
    """Ids of edges that ended by ``cutoff``, or one of whose ends did."""
    own = world.schema.entity(entity)
    link = own.relation(relation)
    edges = world.edges[f"{own.name}.{link.name}"]
    gone = lambda name, side: world.history(name).filter(F.col("expires_at") <= cutoff).select(F.col("id").alias(side))
    ids = [
        edges.filter(F.col("expires_at") <= cutoff),
        edges.join(gone(own.name, "left"), "left", "left_semi"),
        edges.join(gone(link.target, "right"), "right", "left_semi"),
    ]
    rows = reduce(DataFrame.union, [e.select("id") for e in ids]).distinct()
    return rows if batch is None else rows.orderBy("id").limit(batch)


# ---- uniqueness -------------------------------------------------------------

def duplicates(rows: DataFrame, name: str, scopes: Iterable[str] = ()) -> DataFrame:
    """(scopes, value, rows): unique values held twice or more by rows without an end."""
    keys = [*scopes, name]
    return rows.filter(unexpired() & F.col(name).isNotNull()).groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def taken(rows: DataFrame, fresh: DataFrame, name: str, scopes: Iterable[str] = ()) -> DataFrame:
    """Rows of ``fresh`` whose unique value another row without an end holds, within equal scopes."""
    keys = [*scopes, name]
    held = rows.filter(unexpired() & F.col(name).isNotNull()).select(*(F.col(k).alias(f"held_{k}") for k in keys), F.col("id").alias("held_id"))
    match = reduce(lambda a, k: a & fresh[k].eqNullSafe(held[f"held_{k}"]), keys, fresh["id"] != held["held_id"])
    return fresh.filter(F.col(name).isNotNull()).join(held, match, "left_semi")


def shared_targets(rows: DataFrame, column: str) -> DataFrame:
    """(target, rows): targets of an exclusive reference held by several rows without an end."""
    held = rows.filter(unexpired() & F.col(column).isNotNull())
    return held.groupBy(F.col(column).alias("target")).agg(F.count("*").alias("rows")).filter("rows > 1")
