"""Queries on entities: predicates, relation tests, order, paging, counts, linked edges.

A query is put together by ``form``; it compiles into one DataFrame for the root
rows and one for each linked relation, which are never joined together.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_fold
from ..functions.literals import LiteralError, parse
from ..sources.schema import Entity, SchemaError
from .graph import numbered
from .world import World

#: Fixed value: edges that a linked relation may give for a page.
LINK_CAP = 10_000

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class QueryError(ValueError):
    """A query that its schema does not allow, or a budget that it overran."""


@dataclass(frozen=True)
class Test:
    """A field's test; ``op`` is a comparison, ``in``, ``like`` or ``missing``."""

    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class RelationTest:
    """A live edge to a live target with this id, or satisfying a test, exists."""

    relation: str
    target: int | None = None
    test: Test | None = None


@dataclass(frozen=True)
class Form:
    entity: str
    tests: tuple[Test | RelationTest, ...] = ()
    links: tuple[str, ...] = ()
    sorts: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    after: int | None = None
    tally: bool = False

    def _add(self, test: Test | RelationTest) -> Form:
        return replace(self, tests=(*self.tests, test))

    def when(self, name: str, op: str, value: object) -> Form:
        return self._add(Test(name, op, value))

    def any(self, name: str, values: Sequence) -> Form:
        return self._add(Test(name, "in", tuple(values)))

    def missing(self, name: str) -> Form:
        return self._add(Test(name, "missing"))

    def has(self, relation: str, target: int) -> Form:
        return self._add(RelationTest(relation, target=target))

    def some(self, relation: str, name: str, op: str, value: object = None) -> Form:
        return self._add(RelationTest(relation, test=Test(name, op, value)))

    def link(self, relation: str) -> Form:
        return replace(self, links=(*self.links, relation))

    def order(self, name: str, descending: bool = False) -> Form:
        return replace(self, sorts=(*self.sorts, (name, descending)))

    def top(self, n: int) -> Form:
        return replace(self, limit=n)

    def past(self, key: int) -> Form:
        return replace(self, after=key)

    def count(self) -> Form:
        return replace(self, tally=True)

    def shape(self) -> str:
        """The query without its values: queries of one shape compile to plans of one form."""
        bare = lambda t: f"{t.field} {t.op}"
        tests = [f"{t.relation} {'has' if t.test is None else f'some ({bare(t.test)})'}" if isinstance(t, RelationTest) else bare(t) for t in self.tests]
        sorts = [f"{n} {'desc' if d else 'asc'}" for n, d in self.sorts]
        paging = [w for w, x in (("limit", self.limit), ("after", self.after)) if x is not None]
        return "; ".join([f"from {self.entity}", *tests, *(f"link {x}" for x in self.links), *sorts, *paging, *(["count"] if self.tally else [])])

    def digest(self) -> str:
        """A name for the query with its values, for caching results of one version."""
        return hashlib.sha256(repr(self).encode()).hexdigest()


def form(entity: str) -> Form:
    return Form(entity)


@dataclass
class Pack:
    """A query's result: the root's rows and the linked edges, or a count."""

    root: str
    rows: DataFrame | None = None
    links: dict[str, DataFrame] = field(default_factory=dict)
    count: DataFrame | None = None

    def one(self) -> DataFrame:
        """The first row."""
        return self.rows.limit(1)

    def json(self) -> dict[str, DataFrame]:
        """The root's rows and the links as one JSON object a row."""
        named = {self.root: self.count if self.rows is None else self.rows, **self.links}
        return {name: df.select(F.to_json(F.struct("*")).alias("json")) for name, df in named.items()}

    def horizon(self) -> DataFrame:
        """The earliest end among all rows returned: until then the result stands."""
        ends = [df.select("expires_at") for df in (self.rows, *self.links.values())]
        return reduce(DataFrame.union, ends).agg(F.min("expires_at").alias("horizon"))


# ---- predicates -------------------------------------------------------------

def literal(kind: str, value: object) -> object:
    """A typed value; text is parsed as the kind demands, before anything runs."""
    if isinstance(value, str):
        return parse(kind, value)
    if kind == "bool" and isinstance(value, bool) or kind == "int" and isinstance(value, int) and not isinstance(value, bool):
        return value
    raise LiteralError(f"{value!r} is no {kind}")


def compare(column: Column, kind: str, test: Test) -> Column:
    """A test on a column of a kind. Absent values satisfy ``missing`` alone."""
    if test.op == "missing":
        return column.isNull()
    if test.op == "in":
        return column.isin(*(literal(kind, v) for v in test.value)) if test.value else F.lit(False)
    if test.op == "like":
        return contains_fold(column, str(test.value)) if kind in ("text", "link") else F.lit(False)
    if test.op not in _COMPARE:
        raise QueryError(f"no test {test.op!r}")
    value = literal(kind, test.value)
    if kind == "bool" and test.op not in ("=", "!="):
        return F.lit(False)  # booleans have no order
    return _COMPARE[test.op](column, F.lit(value))


def condition(entity: Entity, test: Test) -> Column:
    """A test on the entity's own fields."""
    kind = entity.kind(test.field)
    if test.op == "like" and kind not in ("text", "link"):
        raise QueryError(f"like needs text; {test.field} is {kind}")
    if test.field == "id" and test.op == "missing":
        return F.lit(False)
    return compare(F.col(test.field), kind, test)


def conjunction(entity: Entity, tests: Sequence[Test | RelationTest]) -> Column:
    """All tests on a row's own cells; relation tests fail there."""
    parts = [F.lit(False) if isinstance(t, RelationTest) else condition(entity, t) for t in tests]
    return reduce(operator.and_, parts, F.lit(True))


def matching_edges(world: World, entity: Entity, test: RelationTest) -> DataFrame:
    """The ``left`` ids of the edges that satisfy a relation test."""
    relation = entity.relation(test.relation)
    edges = world.held_edges(entity.name, test.relation)
    if test.test is None:
        return edges.filter(F.col("right") == test.target).select("left")
    inner, own = test.test, {f.name: f.kind for f in relation.fields}
    if inner.field == "id" or inner.field in own:  # an edge's field hides the target's of that name
        if inner.op == "missing":
            return edges.filter(F.lit(False)).select("left")
        column = F.col("right") if inner.field == "id" else F.col(inner.field)
        return edges.filter(compare(column, own.get(inner.field, "int"), inner)).select("left")
    target = world.schema.entity(relation.target)
    kept = world.rows(target.name).filter(compare(F.col(inner.field), target.kind(inner.field), inner))
    return edges.join(kept.select(F.col("id").alias("right")), "right", "left_semi").select("left")


# ---- order and pages --------------------------------------------------------

def sort_keys(entity: Entity, sorts: Sequence[tuple[str, bool]]) -> list[tuple[Column, bool]]:
    """(key, descending) columns without nulls that give a query's order.

    Absent text sorts as the empty text. Absent integers and booleans sort after
    all values, so they come first in descending order. Ids break ties, ascending
    in any case.
    """
    out: list[tuple[Column, bool]] = []
    for name, descending in sorts:
        kind, column = entity.kind(name), F.col(name)
        if kind in ("text", "link"):
            out.append((F.coalesce(column, F.lit("")), descending))
        else:
            out += [(column.isNull(), descending), (F.coalesce(column, F.lit(False if kind == "bool" else 0)), descending)]
    return [*out, (F.col("id"), False)]


def ordered(rows: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    return rows.orderBy(*(k.desc() if d else k.asc() for k, d in keys))


def ranked(rows: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """All ``rows`` with their ``rank`` in the order, from 1 on, without gathering them in one task."""
    return numbered(rows, [k.desc() if d else k.asc() for k, d in keys], 1, "rank")


def past(rows: DataFrame, keys: list[tuple[Column, bool]], key: int) -> DataFrame:
    """The rows behind the row of id ``key`` in the order; none if that is not among them.

    One row is fetched for its place in the order, which then filters the scan.
    """
    place = rows.filter(F.col("id") == key).select(*(k.alias(f"k{n}") for n, (k, _) in enumerate(keys))).first()
    if place is None:
        return rows.filter(F.lit(False))
    behind, equal = F.lit(False), F.lit(True)
    for (k, descending), value in zip(keys, place, strict=True):
        behind = behind | (equal & ((k < F.lit(value)) if descending else (k > F.lit(value))))
        equal = equal & (k == F.lit(value))
    return rows.filter(behind)


# ---- running ----------------------------------------------------------------

def selected(world: World, query: Form) -> DataFrame:
    """The live rows that satisfy all tests, in no order."""
    entity = world.schema.entity(query.entity)
    own = [t for t in query.tests if isinstance(t, Test)]
    rows = world.rows(entity.name).filter(conjunction(entity, own))
    for test in query.tests:
        if isinstance(test, RelationTest):
            if test.test is None and test.target is None:
                raise QueryError("a relation test needs a target or a test")
            found = matching_edges(world, entity, test).withColumnRenamed("left", "id")
            rows = rows.join(found, "id", "left_semi")
    return rows


def paged(world: World, query: Form) -> DataFrame:
    """The rows in order, from the cursor on, up to the limit."""
    entity = world.schema.entity(query.entity)
    rows, keys = selected(world, query), sort_keys(entity, query.sorts)
    if query.after is not None:
        rows = past(rows, keys, query.after)
    rows = ordered(rows, keys)
    return rows if query.limit is None else rows.limit(query.limit)


def linked(world: World, entity: Entity, page: DataFrame, relation: str, cap: int | None = LINK_CAP) -> DataFrame:
    """Live edges from the page's rows to live targets, in order of their ids.

    More than ``cap`` of them are an error; None leaves them unbounded.
    """
    edges = world.held_edges(entity.name, relation).join(page.select(F.col("id").alias("left")), "left", "left_semi")
    columns = world.edges[f"{entity.name}.{entity.relation(relation).name}"].columns
    if cap is not None and edges.limit(cap + 1).count() > cap:
        raise QueryError(f"{relation} links more than {cap} edges")
    return edges.select(*columns).orderBy("id")


def run(world: World, query: Form, cap: int | None = LINK_CAP) -> Pack:
    entity = world.schema.entity(query.entity)
    if query.tally:
        return Pack(entity.name, count=selected(world, query).agg(F.count("*").alias("count")))
    page = paged(world, query)
    links = {}
    for name in query.links:
        relation = entity.relation(name)
        if f"{entity.name}.{relation.name}" not in world.edges:
            raise SchemaError(f"no edges of {relation.name}")
        links[f"{entity.name}.{relation.name}"] = linked(world, entity, page, name, cap)
    return Pack(entity.name, page, links)
