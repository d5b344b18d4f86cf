"""Row-level visibility: grants compiled into filters and semi-joins.

A grant row is (who, verb, unit, scope): who is ``anon`` (everyone), ``all`` (any
operator), an id, or ``<group> <id>`` for a group's members; verb may be ``*``;
scope is ``all``, ``row <id>`` or a predicate. A row grant covers the row and all
that it owns. A predicate on the unit itself covers the rows that satisfy it; one
on an owner's unit covers what the owner owns, for seeing only. The value
``@me`` stands for the operator's id.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import live
from .graph import owner_chain
from .query import Form, Pack, Test, conjunction, linked, paged, selected
from .world import World

VERBS = ("see", "put", "set", "end", "tie", "cut", "grant")
ME = "@me"
#: Grants with predicates that one principal may hold for a unit.
MOST_PREDICATES = 1_000


class PolicyError(ValueError):
    """An operation that the principal's grants do not cover."""


@dataclass(frozen=True)
class Principal:
    """Who asks: everything is allowed to ``sudo``; ``operator`` is None for the anonymous."""

    operator: int | None = None
    sudo: bool = False


@dataclass(frozen=True)
class Grant:
    """A grant; ``tests`` is its predicate, ``row`` its row, neither means all rows."""

    who: str
    verb: str
    unit: str
    row: int | None = None
    tests: tuple[Test, ...] | None = None

    def scope(self) -> str:
        return "all" if self.row is None and self.tests is None else "row" if self.tests is None else "pred"


def memberships(world: World, who: Principal) -> DataFrame | None:
    """(group,): the names ``<group> <id>`` of the live groups that the operator belongs to."""
    if who.operator is None:
        return None
    found = []
    for e in world.schema.entities:
        for r in e.relations:
            if r.membership:
                edges = world.relation(e.name, r.name).filter(F.col("right") == who.operator)
                groups = edges.join(world.rows(e.name).select(F.col("id").alias("left")), "left", "left_semi")
                found.append(groups.select(F.concat(F.lit(f"{e.name} "), F.col("left").cast("string")).alias("group")))
    return reduce(DataFrame.union, found).distinct() if found else None


def held(world: World, grants: Sequence[Grant], who: Principal, verb: str) -> list[Grant]:
    """The grants for a verb that name the principal; memberships are looked up once."""
    names = {"anon"} if who.operator is None else {"anon", "all", str(who.operator)}
    groups = sorted({g.who for g in grants if " " in g.who})
    rows = memberships(world, who) if groups else None
    if rows is not None:
        names |= {r["group"] for r in rows.filter(F.col("group").isin(*groups)).collect()}  # at most the grants' groups
    return [g for g in grants if g.who in names and g.verb in ("*", verb)]


def _tests(grant: Grant, who: Principal) -> tuple[Test, ...] | None:
    """The grant's predicate for the principal; None where it needs an operator and there is none."""
    uses_me = any(t.value == ME or isinstance(t.value, tuple) and ME in t.value for t in grant.tests)
    if not uses_me:
        return grant.tests
    if who.operator is None:
        return None
    mine = lambda v: tuple(map(mine, v)) if isinstance(v, tuple) else str(who.operator) if v == ME else v
    return tuple(replace(t, value=mine(t.value)) for t in grant.tests)


def allowed_ids(world: World, entity: str, own: Sequence[Grant], who: Principal, verb: str) -> DataFrame | None:
    """(id,) of live rows that the grants cover; None if they cover all rows.

    ``own`` are the grants that name the principal. Row grants are met along the
    owner chain by one semi-join; predicates become one filter a unit.
    """
    unit = world.schema.entity(entity)
    resolve = lambda g: g.unit if g.unit == "*" else world.schema.entity(g.unit).name
    if any(g.scope() == "all" and resolve(g) in ("*", unit.name) for g in own):
        return None
    parts = []
    chain = owner_chain(world, unit.name)
    rows = [(resolve(g), g.row) for g in own if g.scope() == "row"]
    if rows:
        named = world.rows(unit.name).sparkSession.createDataFrame(rows, "entity string, key long").distinct()
        parts.append(chain.join(named, ["entity", "key"], "left_semi").select("id"))
    by_unit: dict[str, list[tuple[Test, ...]]] = {}
    for g in own:
        tests = _tests(g, who) if g.scope() == "pred" else None
        if tests is not None and (resolve(g) == unit.name or verb == "see"):
            by_unit.setdefault(resolve(g), []).append(tests)
    for name, preds in by_unit.items():
        if len(preds) > MOST_PREDICATES:
            raise PolicyError(f"more than {MOST_PREDICATES} predicates on {name}")
        at = world.schema.entity(name)
        fits = world.rows(name).filter(reduce(operator.or_, [conjunction(at, p) for p in preds]))
        if name == unit.name:
            parts.append(fits.select("id"))
        else:
            keys = fits.select(F.lit(name).alias("entity"), F.col("id").alias("key"))
            parts.append(chain.filter("hop > 0").join(keys, ["entity", "key"], "left_semi").select("id"))
    if not parts:
        return world.rows(unit.name).select("id").filter(F.lit(False))
    return reduce(DataFrame.union, parts).distinct()


def visible(world: World, entity: str, rows: DataFrame, grants: Sequence[Grant], who: Principal, verb: str = "see") -> DataFrame:
    """The ``rows`` (id, ...) that the principal may see."""
    if who.sudo:
        return rows
    ids = allowed_ids(world, entity, held(world, grants, who, verb), who, verb)
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def broad(world: World, entity: str, grants: Sequence[Grant], who: Principal, verb: str = "see") -> bool:
    """Whether a grant on all rows covers the entity."""
    if who.sudo:
        return True
    unit = world.schema.entity(entity).name
    return any(g.scope() == "all" and (g.unit == "*" or world.schema.entity(g.unit).name == unit) for g in held(world, grants, who, verb))


def run_as(world: World, query: Form, grants: Sequence[Grant], who: Principal) -> Pack:
    """A query under a principal.

    The page is cut first and filtered then, so a page may be short. A count sees
    all rows of the query, its page included, that the principal may see. Edges
    stay where their left row stayed and the principal may see their right row.
    """
    entity = world.schema.entity(query.entity)
    if query.tally:
        bare = replace(query, tally=False)
        rows = paged(world, bare) if query.limit is not None or query.after is not None else selected(world, bare)
        return Pack(entity.name, count=visible(world, entity.name, rows, grants, who).agg(F.count("*").alias("count")))
    page = visible(world, entity.name, paged(world, query), grants, who)
    links = {}
    for name in query.links:
        relation = entity.relation(name)
        ends = world.rows(relation.target).select("id")
        seen = visible(world, relation.target, ends, grants, who).select(F.col("id").alias("right"))
        links[f"{entity.name}.{relation.name}"] = linked(world, entity, page, name).join(seen, "right", "left_semi").orderBy("id")
    return Pack(entity.name, page, links)


def change_allowed(world: World, entity: str, after: DataFrame, grants: Sequence[Grant], who: Principal, verb: str = "set") -> DataFrame:
    """The ids of changed rows (``after``: their new cells) that the principal may change.

    The old row must be visible and covered; the new cells are then held against
    the grants with the old row's owners.
    """
    if who.sudo:
        return after.select("id")
    old = visible(world, entity, world.rows(entity).join(after.select("id"), "id", "left_semi"), grants, who)
    own = held(world, grants, who, verb)
    before = allowed_ids(world, entity, own, who, verb)
    if before is None:
        return old.select("id")
    unit = world.schema.entity(entity)
    by_row = [g for g in own if g.scope() != "pred"]
    preds = [p for g in own if g.scope() == "pred" and world.schema.entity(g.unit).name == unit.name for p in [_tests(g, who)] if p is not None]
    parts = [allowed_ids(world, entity, by_row, who, verb)]
    if preds:
        parts.append(after.filter(reduce(operator.or_, [conjunction(unit, p) for p in preds])).select("id"))
    new = reduce(DataFrame.union, parts).distinct()
    return old.select("id").join(before, "id", "left_semi").join(new, "id", "left_semi")


def minted(world: World, entity: str, fresh: DataFrame, grants: Sequence[Grant], who: Principal) -> DataFrame:
    """(who, verb, unit, scope): the ``*`` grants that a creator gets on new rows not yet covered for every verb."""
    rows = fresh.select("id")
    if not who.sudo and who.operator is not None:
        covered = rows
        for verb in VERBS:
            covered = visible(world, entity, covered, grants, who, verb)
        rows = rows.join(covered, "id", "left_anti")
    who_text = "anon" if who.operator is None else str(who.operator)
    name = world.schema.entity(entity).name
    return rows.select(F.lit(who_text).alias("who"), F.lit("*").alias("verb"), F.lit(name).alias("unit"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("scope"))


def may_grant(world: World, grant: Grant, grants: Sequence[Grant], who: Principal) -> bool:
    """Whether the principal holds what it would hand on; grants on unit ``*`` are only for ``sudo``."""
    if who.sudo:
        return True
    if grant.unit == "*":
        return False
    verbs = VERBS if grant.verb == "*" else (grant.verb,)
    for verb in verbs:
        if broad(world, grant.unit, grants, who, verb):
            continue
        if grant.row is None:
            return False
        row = world.rows(grant.unit).filter(live(world.now) & (F.col("id") == grant.row)).select("id")
        if visible(world, grant.unit, row, grants, who, verb).isEmpty():
            return False
    return True
