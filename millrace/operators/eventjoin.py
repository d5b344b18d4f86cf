"""Equi-joins of two filtered sides of one event table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.events import EventError, EventQuery, EventTable, matched, projected


@dataclass(frozen=True)
class Side:
    """A window, equalities, absences and columns; ``equals`` may name any column."""

    on: str
    query: EventQuery = EventQuery()
    equals: dict = field(default_factory=dict)
    missing: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class JoinBudget:
    """The default limits of a join."""

    build_rows: int = 100_000
    rows: int = 1_000_000


def side(table: EventTable, rows: DataFrame, want: Side) -> DataFrame:
    found = matched(table, rows, want.query)
    for name, value in want.equals.items():
        table.kind(name)
        if value is None:
            raise EventError("an equality needs a value; absence is a test of its own")
        found = found.filter(F.col(name) == F.lit(value))
    for name in want.missing:
        table.kind(name)
        found = found.filter(F.col(name).isNull())
    return found


def join(table: EventTable, rows: DataFrame, left: Side, right: Side, mode: str = "left", budget: JoinBudget | None = None) -> DataFrame:
    """(left, right, present): structs of the sides' columns, and whether the right side matched.

    Keys must be of one declared kind. Null keys never match and duplicates
    multiply. In ``left`` mode unmatched left rows stay with ``present`` false, so
    a match with null columns differs from no match. Whether the right side is
    broadcast or shuffled is left to adaptive execution, which knows its bytes.
    """
    if mode not in ("inner", "left"):
        raise EventError(f"no join {mode!r}")
    if table.kind(left.on) != table.kind(right.on):
        raise EventError(f"{left.on} and {right.on} are of different kinds")
    a, b = side(table, rows, left), side(table, rows, right)
    names = lambda df, want: F.struct(*(df[c].alias(c) for c in projected(table, df, want.columns).columns))
    a = a.select(names(a, left).alias("left"), a[left.on].alias("left_on"))
    b = b.select(names(b, right).alias("right"), b[right.on].alias("right_on"), F.lit(True).alias("matched")).filter(F.col("right_on").isNotNull())
    if budget and b.limit(budget.build_rows + 1).count() > budget.build_rows:
        raise EventError(f"the right side has more than {budget.build_rows} rows")
    out = a.join(b, F.col("left_on") == F.col("right_on"), mode)
    out = out.select("left", "right", F.coalesce("matched", F.lit(False)).alias("present"))
    if budget and out.limit(budget.rows + 1).count() > budget.rows:
        raise EventError(f"more than {budget.rows} rows")
    return out
