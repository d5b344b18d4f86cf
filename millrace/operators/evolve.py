"""Schema evolution: the steps between two schemas, their conditions, and generation copies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import convert, filled, is_bool_text, is_int_text, live, violates
from ..sources.schema import Entity, Field, Schema, SchemaError
from .graph import closure, duplicates


@dataclass(frozen=True)
class Step:
    """One difference: ``add``, ``drop``, ``cast``, ``alter`` or ``rename`` of an entity, field, reference or relation.

    ``needs`` names what the data must satisfy: ``empty`` table, ``clear`` of
    dependants, ``unique`` values, ``present`` values, ``values`` that convert or
    fit, or ``authority`` to lose data.
    """

    action: str
    entity: str
    name: str
    needs: tuple[str, ...] = ()


#: Kinds that a field may change between.
CASTS = {("text", "int"), ("text", "bool"), ("int", "text"), ("bool", "text"), ("int", "bool"), ("bool", "int"), ("link", "text"), ("text", "link")}


class EvolutionError(SchemaError):
    """A change that can't be made, or data that don't allow it."""


def _field_steps(entity: str, old: Field, new: Field) -> list[Step]:
    out = []
    if old.kind != new.kind:
        if (old.kind, new.kind) not in CASTS:
            raise EvolutionError(f"{entity}.{old.name} can't become {new.kind}")
        out.append(Step("cast", entity, new.name, ("values",)))
    needs = []
    if old.optional and not new.optional and new.default is None:
        needs.append("present")
    if new.unique is not None and old.unique != new.unique:
        needs.append("unique")
    if (new.values, new.low, new.high) != (old.values, old.low, old.high) and (new.values or new.low is not None or new.high is not None):
        needs.append("values")
    if (old.optional, old.unique, old.values, old.low, old.high, old.default, old.serial) != (new.optional, new.unique, new.values, new.low, new.high, new.default, new.serial):
        out.append(Step("alter", entity, new.name, tuple(needs)))
    return out


def difference(old: Schema, new: Schema) -> list[Step]:
    """The steps from one schema to the other, in the order of their names."""
    before, after = ({e.name: e for e in s.entities} for s in (old, new))
    out: list[Step] = []
    for name in sorted(before.keys() - after.keys()):
        out.append(Step("drop", name, name, ("clear", "authority")))
    for name in sorted(after.keys() - before.keys()):
        out.append(Step("add", name, name))
    for name in sorted(before.keys() & after.keys()):
        a, b = before[name], after[name]
        for part in ("fields", "references", "relations"):
            had, has = ({x.name: x for x in getattr(e, part)} for e in (a, b))
            out += [Step("drop", name, k, ("authority",)) for k in sorted(had.keys() - has.keys())]
            for k in sorted(has.keys() - had.keys()):
                x = has[k]
                filled_in = part == "relations" or x.optional or (part == "fields" and (x.default is not None or x.serial is not None))
                out.append(Step("add", name, k, () if filled_in else ("empty",)))
            for k in sorted(has.keys() & had.keys()):
                if part == "fields":
                    out += _field_steps(name, had[k], has[k])
                elif had[k] != has[k]:
                    target = "empty" if had[k].target != has[k].target else "values"
                    out.append(Step("alter", name, k, (target,)))
        if (a.frozen, a.hidden) != (b.frozen, b.hidden):
            out.append(Step("alter", name, name))
    return out


def renamed(old: Schema, new: Schema) -> tuple[str, str] | None:
    """(before, after) if the only change is the name of one entity that nothing points to."""
    before, after = ({e.name: e for e in s.entities} for s in (old, new))
    gone, come = before.keys() - after.keys(), after.keys() - before.keys()
    if len(gone) != 1 or len(come) != 1:
        return None
    a, b = before[next(iter(gone))], after[next(iter(come))]
    same = Entity(b.name, a.fields, a.references, a.relations, a.frozen, a.hidden) == b
    pointed = any(r.target == a.name for e in old.entities for r in (*e.references, *e.relations))
    rest = all(before[n] == after[n] for n in before.keys() & after.keys())
    return (a.name, b.name) if same and rest and not pointed else None


def cast_failures(rows: DataFrame, name: str, before: str, after: str) -> DataFrame:
    """(id, value): present values that do not convert; text becomes an integer only in canonical form."""
    column = F.col(name)
    if before in ("text", "link") and after == "int":
        bad = ~is_int_text(column)
    elif before in ("text", "link") and after == "bool":
        bad = ~is_bool_text(column)
    elif before == "int" and after == "bool":
        bad = ~column.isin(0, 1)
    else:
        bad = F.lit(False)
    return rows.filter(column.isNotNull() & bad).select("id", column.cast("string").alias("value"))


def unmet(old: Schema, new: Schema, tables: dict[str, DataFrame], now: int, authority: bool = False) -> list[tuple[Step, str]]:
    """The steps whose needs the live data do not satisfy."""
    out = []
    before, after = ({e.name: e for e in s.entities} for s in (old, new))
    for step in difference(old, new):
        rows = tables[step.entity].filter(live(now)) if step.entity in before else None
        a = next((f for f in before[step.entity].fields if f.name == step.name), None) if step.entity in before else None
        b = next((f for f in after[step.entity].fields if f.name == step.name), None) if step.entity in after else None
        for need in step.needs:
            if need == "authority":
                bad = not authority
            elif need == "clear":
                bad = any(r.target == step.entity for e in new.entities for r in (*e.references, *e.relations))
            elif need == "empty":
                bad = not rows.isEmpty()
            elif need == "present":
                bad = not rows.filter(F.col(step.name).isNull()).isEmpty()
            elif need == "unique":
                bad = not duplicates(rows, step.name, b.unique).isEmpty()
            elif a is not None and b is not None:
                bad = not cast_failures(rows, step.name, a.kind, b.kind).isEmpty()
                if not bad and (b.values or b.low is not None or b.high is not None):
                    value = convert(F.col(step.name), a.kind, b.kind)
                    bad = not rows.filter(violates(value, list(b.values) if b.values else None, b.low, b.high)).isEmpty()
            else:
                bad = not rows.isEmpty()
            if bad:
                out.append((step, need))
    return out


def copied(old: Entity, new: Entity, rows: DataFrame, now: int) -> DataFrame:
    """The live rows of ``old`` as rows of ``new``: converted, defaults filled in, new optional fields absent."""
    kinds = {f.name: f.kind for f in old.fields}
    columns = [F.col("id")]
    for f in new.fields:
        value = convert(F.col(f.name), kinds[f.name], f.kind) if f.name in kinds else F.lit(None)
        columns.append((filled(value, f.default) if f.default is not None else value).alias(f.name))
    had = {r.column for r in old.references}
    columns += [(F.col(r.column) if r.column in had else F.lit(None)).alias(r.column) for r in new.references]
    copy = rows.filter(live(now)).select(*columns, "expires_at", "created_at", "updated_at")
    return copy.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in new.struct()))


def generation(old: Schema, new: Schema, tables: dict[str, DataFrame], edges: dict[str, DataFrame], now: int, authority: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables and edges of the next generation; refused if a step's needs are unmet."""
    problems = unmet(old, new, tables, now, authority)
    if problems:
        raise EvolutionError("; ".join(f"{s.action} {s.entity}.{s.name} needs {n}" for s, n in problems))
    before = {e.name: e for e in old.entities}
    out, out_edges = {}, {}
    for e in new.entities:
        if e.name in before:
            out[e.name] = copied(before[e.name], e, tables[e.name], now)
        for r in e.relations:
            name = f"{e.name}.{r.name}"
            if name in edges:
                out_edges[name] = edges[name].filter(live(now))
                if r.closure:
                    pairs = closure(out_edges[name])
                    out_edges[f"{name}_closure"] = pairs.select(F.col("root").alias("left"), F.col("reach").alias("right"))
    return out, out_edges


def dropped_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that the older generation has and the newer one has not."""
    return before.select("id").subtract(after.select("id"))


def kept_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that both generations have."""
    return before.select("id").intersect(after.select("id"))


def outbox(old: Schema, new: Schema, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(entity, field, key): data gone with a generation: rows of dropped keys, and values of dropped fields on kept keys."""
    parts = []
    names = {e.name: e for e in new.entities}
    for e in old.entities:
        rows = before[e.name]
        if e.name not in names:
            parts.append(rows.select(F.lit(e.name).alias("entity"), F.lit(None).cast("string").alias("field"), F.col("id").alias("key")))
            continue
        gone = dropped_keys(rows, after[e.name])
        parts.append(gone.select(F.lit(e.name).alias("entity"), F.lit(None).cast("string").alias("field"), F.col("id").alias("key")))
        left = {f.name for f in names[e.name].fields}
        for f in e.fields:
            if f.name not in left:
                held = rows.filter(F.col(f.name).isNotNull())
                parts.append(kept_keys(held, after[e.name]).select(F.lit(e.name).alias("entity"), F.lit(f.name).alias("field"), F.col("id").alias("key")))
    return reduce(DataFrame.unionByName, parts)


def catalog(tables: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, detail): every table with its part (rows or edges), and every column with its type, as they are."""
    rows = []
    for part, some in (("rows", tables), ("edges", edges)):
        for name, df in some.items():
            rows.append(("table", name, part))
            rows += [("column", f"{name}.{c.name}", c.dataType.simpleString()) for c in df.schema]
    session = next(iter([*tables.values(), *edges.values()])).sparkSession
    return session.createDataFrame(rows, "kind string, name string, detail string")


def drifted(schema: Schema, tables: dict[str, DataFrame]) -> list[str]:
    """Entities whose tables do not have the schema's columns and types."""
    shape = lambda s: [(c.name, c.dataType.simpleString()) for c in s]
    return [e.name for e in schema.entities if e.name not in tables or shape(tables[e.name].schema) != shape(e.struct())]


def clocks(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, last): the largest id of each table; new ids count on from there."""
    parts = [df.agg(F.max("id").alias("last")).select(F.lit(name).alias("entity"), F.coalesce("last", F.lit(0)).alias("last")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
