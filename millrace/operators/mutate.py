"""Batches of changes, checked as a whole and applied as new tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import violates
from ..functions.joins import null_safe_join
from ..sources.schema import Entity, edge_struct
from .graph import closes_cycle, closure, numbered, taken
from .world import World


class Refused(ValueError):
    """A batch that breaks the rules; nothing of it is applied."""


@dataclass
class Batch:
    """New tables and the change log rows (verb, unit, key) of one batch."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    log: list[DataFrame] = field(default_factory=list)

    def changes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.log)


def _log(rows: DataFrame, verb: str, unit: str, key: str = "id") -> DataFrame:
    return rows.select(F.lit(verb).alias("verb"), F.lit(unit).alias("unit"), F.col(key).alias("key"))


def broken(world: World, entity: Entity, fresh: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, rule): every rule that the ``fresh`` rows break against the table ``rows`` and among themselves."""
    out = []
    note = lambda bad, rule: out.append(bad.select("id", F.lit(rule).alias("rule")))
    for f in entity.fields:
        if not f.optional and f.serial is None:
            note(fresh.filter(F.col(f.name).isNull()), f"{f.name} is required")
        if f.values or f.low is not None or f.high is not None:
            note(fresh.filter(violates(F.col(f.name), list(f.values) if f.values else None, f.low, f.high)), f"{f.name} is out of its domain")
        if f.unique is not None:
            others = rows.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*rows.columns))
            note(taken(others, fresh, f.name, f.unique), f"{f.name} is taken")
    for r in entity.references:
        if not r.optional:
            note(fresh.filter(F.col(r.column).isNull()), f"{r.name} is required")
        ends = world.rows(r.target).select(F.col("id").alias(r.column))
        note(fresh.filter(F.col(r.column).isNotNull()).join(ends, r.column, "left_anti"), f"{r.name} points to no live row")
        if r.exclusive:
            others = rows.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*rows.columns))
            note(taken(others, fresh, r.column), f"{r.name} is held by another row")
    return reduce(DataFrame.union, out) if out else fresh.select("id", F.lit("").alias("rule")).filter(F.lit(False))


def _require(problems: DataFrame) -> None:
    found = problems.limit(5).collect()
    if found:
        raise Refused("; ".join(f"row {r['id']}: {r['rule']}" for r in found))


#: What may name an edge: its id, and its ends too where edges share ids.
EDGE = ("id", "left", "right")


def _naming(changes: DataFrame) -> list[str]:
    """The columns by which ``changes`` name edges."""
    return [c for c in EDGE if c in changes.columns]


def _once(changes: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """(id, rule): rows or edges that ``changes`` name more than once."""
    return changes.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("given twice").alias("rule"))


def _known(changes: DataFrame, rows: DataFrame, rule: str, on: Sequence[str] = ("id",)) -> DataFrame:
    return changes.join(rows.select(*on), list(on), "left_anti").select("id", F.lit(rule).alias("rule"))


def _unfrozen(own: Entity) -> None:
    if own.frozen:
        raise Refused(f"{own.name} is frozen")


def with_serials(entity: Entity, fresh: DataFrame, rows: DataFrame) -> DataFrame:
    """``fresh`` with serial fields counted on, within their scopes, in the order of ids.

    Every row that ever was counts, dead ones too, so numbers are not given twice.
    """
    for f in entity.fields:
        if f.serial is None:
            continue
        scopes = list(f.serial)
        last = rows.groupBy(*scopes).agg(F.max(f.name).alias("last")) if scopes else rows.agg(F.max(f.name).alias("last"))
        ranked = numbered(fresh, [*scopes, "id"], 0, "nth")  # a scope may hold most rows: no window gathers it
        if scopes:  # rows with an absent scope count among themselves
            starts = ranked.groupBy(*scopes).agg(F.min("nth").alias("start"), F.count("*").alias("size"))
            known = last.select(*(F.col(c).alias(f"last_{c}") for c in scopes), "last")
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"last_{c}")) for c in scopes])
            facts = starts.join(known, same, "left").select(*scopes, "start", "size", "last")
            ranked = null_safe_join(ranked, facts, scopes, "size", ranked.count())
        else:
            ranked = ranked.withColumn("start", F.lit(0)).join(F.broadcast(last))  # one row
        fresh = ranked.withColumn(f.name, F.coalesce("last", F.lit(0)) + F.col("nth") - F.col("start") + 1).select(*dict.fromkeys([*fresh.columns, f.name]))
    return fresh


def insert(world: World, entity: str, values: DataFrame, next_id: int) -> Batch:
    """New rows from ``values`` (fields and references): ids, defaults, serials, checks."""
    own = world.schema.entity(entity)
    rows = world.history(own.name)
    columns = values.columns
    fresh = values if "id" in columns else numbered(values, columns, next_id)
    for f in own.fields:
        given = F.col(f.name) if f.name in columns else F.lit(None)
        fresh = fresh.withColumn(f.name, F.coalesce(given, F.lit(f.default)) if f.default is not None else given)
    for r in own.references:
        if r.column not in columns:
            fresh = fresh.withColumn(r.column, F.lit(None))
    ends = F.col("expires_at") if "expires_at" in columns else F.lit(None)
    fresh = fresh.withColumn("expires_at", ends).withColumn("created_at", F.lit(world.now)).withColumn("updated_at", F.lit(world.now))
    fresh = with_serials(own, fresh, rows)
    fresh = fresh.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in own.struct()))
    _require(broken(world, own, fresh, rows))
    return Batch({own.name: rows.select(*fresh.columns).unionByName(fresh)}, log=[_log(fresh, "put", own.name)])


def update(world: World, entity: str, changes: DataFrame, unset: tuple[str, ...] = ()) -> Batch:
    """Rows with the named fields of ``changes`` (id, ...) set; ``unset`` fields, all optional, become absent.

    Only live rows change; ids without one are refused, and frozen entities too.
    """
    own = world.schema.entity(entity)
    _unfrozen(own)
    optional = {f.name for f in own.fields if f.optional} | {r.column for r in own.references if r.optional}
    if set(unset) - optional:
        raise Refused(f"{sorted(set(unset) - optional)} can't be unset")
    rows = world.history(own.name)
    names = [c for c in changes.columns if c != "id"]
    for name in names:
        own.kind(name)
    _require(_known(changes, world.rows(own.name), "no live row").union(_once(changes)))
    new = changes.select("id", *(F.col(n).alias(f"new_{n}") for n in names), F.lit(True).alias("changes"))
    joined = rows.join(new, "id", "left")
    for name in rows.columns:
        if name in names:
            joined = joined.withColumn(name, F.when(F.col("changes"), F.col(f"new_{name}")).otherwise(F.col(name)))
        elif name in unset:
            joined = joined.withColumn(name, F.when(F.col("changes").isNull(), F.col(name)))
    joined = joined.withColumn("updated_at", F.when(F.col("changes"), F.lit(world.now)).otherwise(F.col("updated_at")))
    fresh = joined.filter("changes").select(*rows.columns)
    _require(broken(world, own, fresh, rows))
    return Batch({own.name: joined.select(*rows.columns)}, log=[_log(changes, "set", own.name)])


def lease(world: World, entity: str, ends: DataFrame) -> Batch:
    """Rows ending at the given times (id, expires_at); a leased row keeps living but holds no unique key.

    Only live rows can be leased; frozen entities too, as their rows may end.
    """
    own = world.schema.entity(entity)
    rows = world.history(own.name)
    _require(_known(ends, world.rows(own.name), "no live row").union(_once(ends)))
    joined = rows.join(ends.select("id", F.col("expires_at").alias("new_end")), "id", "left")
    table = joined.withColumn("expires_at", F.coalesce("new_end", "expires_at")).select(*rows.columns)
    return Batch({own.name: table}, log=[_log(ends, "end", own.name)])


def connect(world: World, entity: str, relation: str, pairs: DataFrame, next_id: int) -> Batch:
    """New edges from ``pairs`` (left, right, fields): live ends, no live twin, no cycle in closures."""
    own = world.schema.entity(entity)
    link = own.relation(relation)
    name = f"{own.name}.{link.name}"
    edges = world.edges[name]
    live_edges = world.relation(own.name, link.name)
    problems = []
    note = lambda bad, rule: problems.append(bad.select(F.col("left").alias("id"), F.lit(rule).alias("rule")))
    _unfrozen(own)
    note(pairs.join(world.rows(own.name).select(F.col("id").alias("left")), "left", "left_anti"), "no live left row")
    note(pairs.join(world.rows(link.target).select(F.col("id").alias("right")), "right", "left_anti"), "no live right row")
    note(pairs.join(live_edges, ["left", "right"], "left_semi"), "a live edge exists")
    note(pairs.groupBy("left", "right").count().filter("count > 1"), "an edge is given twice")
    if link.closure:
        whole = live_edges.select("left", "right").union(pairs.select("left", "right"))
        note(closes_cycle(closure(whole), pairs.select("left", "right")), "the edge closes a cycle")
    _require(reduce(DataFrame.union, problems))
    fresh = pairs if "id" in pairs.columns else numbered(pairs, ["left", "right"], next_id)
    for f in link.fields:
        if f.name not in fresh.columns:
            fresh = fresh.withColumn(f.name, F.lit(f.default))
    fresh = fresh.withColumn("expires_at", F.lit(None)).withColumn("created_at", F.lit(world.now)).withColumn("updated_at", F.lit(world.now))
    fresh = fresh.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in edge_struct(link)))
    return Batch(edges={name: edges.select(*fresh.columns).unionByName(fresh)}, log=[_log(fresh, "tie", name)])


def tune(world: World, entity: str, relation: str, changes: DataFrame) -> Batch:
    """Edges with fields of ``changes`` (id, or id, left and right, ...) set: live edges with live ends, each once; no edge of a frozen entity."""
    own = world.schema.entity(entity)
    _unfrozen(own)
    link = own.relation(relation)
    name = f"{own.name}.{link.name}"
    edges = world.edges[name]
    on = _naming(changes)
    names = [c for c in changes.columns if c not in on]
    if not names or set(names) - {f.name for f in link.fields}:
        raise Refused(f"{name} has no fields {names}")
    lefts = world.rows(own.name).select(F.col("id").alias("left"))
    held = world.held_edges(own.name, link.name).join(lefts, "left", "left_semi")
    _require(_known(changes, held, "no live edge", on).union(_once(changes, on)))
    new = changes.select(*on, *(F.col(n).alias(f"new_{n}") for n in names), F.lit(True).alias("changes"))
    joined = edges.join(new, on, "left")
    for n in names:
        joined = joined.withColumn(n, F.when(F.col("changes"), F.col(f"new_{n}")).otherwise(F.col(n)))
    joined = joined.withColumn("updated_at", F.when(F.col("changes"), F.lit(world.now)).otherwise(F.col("updated_at")))
    return Batch(edges={name: joined.select(*edges.columns)}, log=[_log(changes, "tune", name)])


def disconnect(world: World, entity: str, relation: str, ids: DataFrame) -> Batch:
    """Edges of ``ids`` (id, or id, left and right) ended now; unknown ones are refused, and edges of frozen entities."""
    own = world.schema.entity(entity)
    _unfrozen(own)
    name = f"{own.name}.{own.relation(relation).name}"
    edges = world.edges[name]
    on = _naming(ids)
    _require(_known(ids, edges, "no edge", on).union(_once(ids, on)))
    joined = edges.join(ids.select(*on, F.lit(True).alias("cut")), on, "left")
    ended = lambda column: F.when(F.col("cut"), F.lit(world.now)).otherwise(F.col(column))
    table = joined.withColumn("expires_at", ended("expires_at")).withColumn("updated_at", ended("updated_at")).select(*edges.columns)
    return Batch(edges={name: table}, log=[_log(ids, "cut", name)])
