"""The tables that operators work on: a schema with its rows and edges at a time."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import live
from ..sources.schema import Entity, Reference, Schema

#: Fixed value: hops followed through owners, and layers of a cascade.
DEPTH = 16


@dataclass(frozen=True)
class World:
    """Rows by entity name and edges by ``<entity>.<relation>``, dead ones included, and the time of reading."""

    schema: Schema
    tables: Mapping[str, DataFrame]
    edges: Mapping[str, DataFrame]
    now: int

    def rows(self, entity: str) -> DataFrame:
        """Live rows."""
        return self.history(entity).filter(live(self.now))

    def history(self, entity: str) -> DataFrame:
        """All rows, dead ones included."""
        return self.tables[self.schema.entity(entity).name]

    def point(self, entity: str, key: int) -> DataFrame:
        return self.rows(entity).filter(F.col("id") == key)

    def trace(self, entity: str, key: int) -> DataFrame:
        """The row of an id, dead or live."""
        return self.history(entity).filter(F.col("id") == key)

    def equal(self, entity: str, values: Mapping[str, object]) -> DataFrame:
        """Live rows with these values of fields or references; the source filters by them."""
        rows, own = self.rows(entity), self.schema.entity(entity)
        for name, value in values.items():
            own.kind(name)
            rows = rows.filter(F.col(name) == F.lit(value))
        return rows.orderBy("id")

    def relation(self, entity: str, relation: str) -> DataFrame:
        """Live edges, whatever their targets are."""
        own = self.schema.entity(entity)
        return self.edges[f"{own.name}.{own.relation(relation).name}"].filter(live(self.now))

    def edges_of(self, entity: str, relation: str, left: int) -> DataFrame:
        return self.relation(entity, relation).filter(F.col("left") == left).orderBy("id")

    def held_edges(self, entity: str, relation: str) -> DataFrame:
        """Live edges to live targets."""
        target = self.schema.entity(entity).relation(relation).target
        ends = self.rows(target).select(F.col("id").alias("right"))
        return self.relation(entity, relation).join(ends, "right", "left_semi")

    def parents(self) -> list[tuple[Entity, Reference]]:
        """Every entity with its owner reference."""
        return [(e, e.owner) for e in self.schema.entities if e.owner]
