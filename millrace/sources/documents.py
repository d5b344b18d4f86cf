"""JSON documents in VARIANT columns: shapes, conditions, projections, revisions."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import json_path


class DocumentError(ValueError):
    """A shape, pointer or revision that is not allowed."""


# ---- shapes -----------------------------------------------------------------

@dataclass(frozen=True)
class Shape:
    """What a value may be: any, null, bool, number, text, array, map, object or nullable.

    ``of`` is the shape of elements or of the value that may be null; ``members``
    are an object's (name, shape, required). Objects are closed: other members
    are refused.
    """

    kind: str
    of: Shape | None = None
    members: tuple[tuple[str, Shape, bool], ...] = ()


ANY, NULL, BOOL, NUMBER, TEXT = (Shape(k) for k in ("any", "null", "bool", "number", "text"))


def array(of: Shape) -> Shape:
    return Shape("array", of)


def mapping(of: Shape) -> Shape:
    return Shape("map", of)


def nullable(of: Shape) -> Shape:
    return Shape("nullable", of)


def obj(**members: Shape | tuple[Shape, bool]) -> Shape:
    """An object; a pair (shape, False) is an optional member."""
    full = [(n, *(m if isinstance(m, tuple) else (m, True))) for n, m in members.items()]
    return Shape("object", members=tuple(full))


def problem(shape: Shape, value: object, path: str = "") -> str | None:
    """The first problem of a parsed value: ``missing``, ``kind`` or ``unknown`` and where."""
    if shape.kind == "nullable":
        return None if value is None else problem(shape.of, value, path)
    tests = {
        "any": lambda v: True,
        "null": lambda v: v is None,
        "bool": lambda v: isinstance(v, bool),
        "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        "text": lambda v: isinstance(v, str),
        "array": lambda v: isinstance(v, list),
        "map": lambda v: isinstance(v, dict),
        "object": lambda v: isinstance(v, dict),
    }
    if not tests[shape.kind](value):
        return f"kind {path or '/'}"
    at = lambda k: f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
    if shape.kind in ("array", "map"):
        items = enumerate(value) if shape.kind == "array" else value.items()
        return next((p for k, v in items if (p := problem(shape.of, v, at(k)))), None)
    if shape.kind == "object":
        names = {n for n, _, _ in shape.members}
        for name, inner, required in shape.members:
            if name in value:
                if found := problem(inner, value[name], at(name)):
                    return found
            elif required:
                return f"missing {at(name)}"
        return next((f"unknown {at(k)}" for k in value if k not in names), None)
    return None


_SIMPLE = {"null": ("VOID",), "bool": ("BOOLEAN",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "text": ("STRING",), "object": ("OBJECT",), "map": ("OBJECT",), "array": ("ARRAY",)}


def _kind(value: Column) -> Column:
    """The leading name of a VARIANT's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def flat(shape: Shape) -> bool:
    """Whether a shape can be checked by column expressions alone: an object of simple members."""
    simple = lambda s: s.kind in ("any", "null", "bool", "number", "text") or s.kind == "nullable" and simple(s.of)
    return shape.kind == "object" and all(simple(s) for _, s, _ in shape.members)


def flat_problem(shape: Shape, document: Column) -> Column:
    """The first problem of a document of a flat shape, null if there is none, without Python."""
    member = lambda n: F.variant_get(document, json_path("/" + n.replace("~", "~0").replace("/", "~1")), "variant")

    def of(name: str, inner: Shape, required: bool) -> Column:
        value, may_be_null = member(name), inner.kind in ("nullable", "any", "null")
        base = inner.of if inner.kind == "nullable" else inner
        absent = value.isNull()
        bad = F.lit(False) if base.kind == "any" else ~_kind(value).isin(*_SIMPLE[base.kind])
        if may_be_null:
            bad = bad & ~F.is_variant_null(value)
        return F.when(absent, F.lit(f"missing /{name}") if required else F.lit(None)).when(bad, F.lit(f"kind /{name}"))

    names = F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))
    known = F.array(*(F.lit(n) for n, _, _ in shape.members))
    unknown = F.element_at(F.sort_array(F.array_except(names, known)), 1)
    extra = F.when(F.size(F.array_except(names, known)) > 0, F.concat(F.lit("unknown /"), unknown))
    parts = [of(*m) for m in shape.members]
    return F.when(_kind(document) != "OBJECT", F.lit("kind /")).otherwise(F.coalesce(*parts, extra))


def judged(shape: Shape, column: str) -> Column:
    """The first problem of each document under a shape; recursive shapes are checked in Arrow batches."""
    if flat(shape):
        return flat_problem(shape, F.col(column))

    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: problem(shape, json.loads(t)) if t is not None else "kind /")

    return F.pandas_udf(check, T.StringType())(F.to_json(F.col(column)))


def violations(documents: DataFrame, shape: Shape, column: str = "document", key: str = "id") -> DataFrame:
    """(key, problem) of the documents that break a shape."""
    return documents.select(key, judged(shape, column).alias("problem")).filter("problem is not null")


def widens(old: Shape, new: Shape) -> bool:
    """Whether everything of the old shape fits the new one and objects only gain optional members at the end."""
    if new.kind == "any" or old == new:
        return True
    if new.kind == "nullable":
        return old.kind == "null" or widens(old.of if old.kind == "nullable" else old, new.of)
    if old.kind != new.kind:
        return False
    if old.kind in ("array", "map"):
        return widens(old.of, new.of)
    if old.kind == "object":
        had, has = old.members, new.members
        same = all(a[0] == b[0] and a[2] == b[2] and widens(a[1], b[1]) for a, b in zip(had, has, strict=False))
        return len(has) >= len(had) and same and not any(required for _, _, required in has[len(had) :])
    return True


# ---- queries ----------------------------------------------------------------

@dataclass(frozen=True)
class Equal:
    """The value at a pointer equals a JSON value, deeply."""

    path: str
    value: object


@dataclass(frozen=True)
class Missing:
    """Nothing is at a pointer; a JSON null is something."""

    path: str


def at(document: Column, pointer: str) -> Column:
    """What is at a pointer: SQL null if nothing is, a VARIANT null for a JSON null."""
    return F.variant_get(document, json_path(pointer), "variant")


def canonical(value: object) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))


def test(document: Column, condition: Equal | Missing) -> Column:
    value = at(document, condition.path)
    if isinstance(condition, Missing):
        return value.isNull()
    return F.coalesce(F.to_json(value) == canonical(condition.value), F.lit(False))


def through_scalar(document: Column, pointer: str) -> Column:
    """Whether a pointer goes into a scalar, which is an error and not an absence."""
    steps = pointer.split("/")[1:]
    inside = ["".join(f"/{s}" for s in steps[:k]) for k in range(len(steps))]
    scalar = [F.coalesce(~_kind(at(document, p)).isin("OBJECT", "ARRAY", "VOID"), F.lit(False)) for p in inside]
    return reduce(lambda a, b: a | b, scalar, F.lit(False))


def select(documents: DataFrame, conditions: Sequence[Equal | Missing], fields: Sequence[tuple[str, str]], column: str = "document", key: str = "id") -> DataFrame:
    """(key, fields): the documents that satisfy all conditions, as maps of name to JSON text.

    Missing paths are left out of the map, JSON nulls stay as ``null``.
    """
    names = [n for n, _ in fields]
    if len(set(names)) != len(names):
        raise DocumentError("two fields of one name")
    rows = reduce(lambda df, c: df.filter(test(F.col(column), c)), conditions, documents)
    if not names:
        return rows.select(key, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).alias("fields"))
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.to_json(at(F.col(column), p)).alias("value")) for n, p in fields))
    present = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    return rows.select(key, present.alias("fields"))


# ---- revisions --------------------------------------------------------------

def shuffled(rows: DataFrame) -> DataFrame:
    """The right side of a join that is never broadcast.

    Spark takes a file's compressed bytes for the size of its rows, so keys of a
    table of documents may seem small and fill the driver.
    """
    return rows.hint("merge")


def current(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """The documents at their heads' tokens: heads (collection, id, token) with payloads (id, token, document)."""
    return heads.join(shuffled(payloads), ["id", "token"])


def inventory(documents: DataFrame, visible_heads: DataFrame) -> DataFrame:
    """Documents with a visible head, in order of their ids; others are skipped."""
    return documents.join(visible_heads.select("id"), "id", "left_semi").orderBy("id")


def revise(heads: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new heads, and the edits refused.

    ``edits`` are (id, base, token): a new revision of id on top of ``base``. An
    edit stands if its base is the head's token and no other edit has that base;
    of several, the one of the smallest token stands.
    """
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("id", "base").orderBy("token"))
    ranked = edits.withColumn("nth", first)
    on_head = ranked.join(heads.select("id", F.col("token").alias("base")), ["id", "base"], "left_semi")
    wins = on_head.filter("nth = 1").select("id", F.col("token").alias("new_token"))
    moved = heads.join(wins, "id", "left").withColumn("token", F.coalesce("new_token", "token")).select(*heads.columns)
    lost = edits.join(wins.select("id", F.col("new_token").alias("token")), ["id", "token"], "left_anti")
    return moved, lost


def revision(key: Column, base: Column, document: Column) -> Column:
    """The token of a document's revision on top of ``base``; the first stands on "0"."""
    return F.sha2(F.concat_ws(":", key.cast("string"), base, F.to_json(document)), 256)


def create(heads: DataFrame, payloads: DataFrame, fresh: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads and payloads with the new documents of ``fresh`` (collection, id, document), and (id, problem) of those refused.

    Ids must be present, new and given once, and documents of the collection's shape.
    """
    twice = fresh.groupBy("id").agg((F.count("*") > 1).alias("is_twice"))
    held = heads.select("id", F.lit(True).alias("is_held")).distinct()
    rows = fresh.select("collection", "id", "document").join(shuffled(twice), "id", "left").join(shuffled(held), "id", "left")
    early = F.when(F.col("id").isNull(), F.lit("id is absent")).when(F.col("is_twice"), F.lit("id given twice")).when(F.col("is_held"), F.lit("id exists"))
    rows = rows.withColumn("problem", F.coalesce(early, judged(shape, "document")))
    made = rows.filter("problem is null").withColumn("token", revision(F.col("id"), F.lit("0"), F.col("document")))
    refused = rows.filter("problem is not null").select("id", "problem").distinct()
    return heads.unionByName(made.select(*heads.columns)), payloads.unionByName(made.select(*payloads.columns)), refused


def edit(heads: DataFrame, payloads: DataFrame, edits: DataFrame, shape: Shape, sets: Mapping[str, object], removes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads and payloads after one patch of the documents that ``edits`` (id, base) name, and (id, problem) of those refused.

    A base that is not the head's token is refused, and so is a result of another
    shape; edits of one id and base are one edit.
    """
    tops = heads.select("id", F.col("token").alias("base"), F.lit(True).alias("on_head"))
    asked = edits.select("id", "base").distinct().join(shuffled(tops), ["id", "base"], "left")
    stale = asked.filter("on_head is null").select("id", F.lit("base is not the head").alias("problem"))
    now = current(asked.filter("on_head").select("id", F.col("base").alias("token")), payloads).select("id", F.col("token").alias("base"), "document")
    rows = patched(now, sets, removes).withColumn("problem", judged(shape, "document"))
    bad = rows.filter("problem is not null").select("id", "problem")
    made = rows.filter("problem is null").select("id", revision(F.col("id"), F.col("base"), F.col("document")).alias("token"), "document")
    new = made.select("id", F.col("token").alias("new_token"))
    moved = heads.join(shuffled(new), "id", "left").withColumn("token", F.coalesce("new_token", "token"))
    return moved.select(*heads.columns), payloads.unionByName(made.select(*payloads.columns)), stale.union(bad)


def end(heads: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heads without those that ``ends`` (id, token) name at their present token, and the ends refused."""
    known = ends.select("id", "token").distinct()
    left = heads.join(shuffled(known), ["id", "token"], "left_anti").select(*heads.columns)
    return left, known.join(shuffled(heads.select("id", "token")), ["id", "token"], "left_anti")


def evolve(documents: DataFrame, old: Shape, new: Shape) -> DataFrame:
    """The documents under a wider shape; refused if it isn't one, or if a document doesn't have it."""
    if not widens(old, new):
        raise DocumentError("the new shape does not take all that the old one takes")
    bad = violations(documents, new).limit(5).collect()
    if bad:
        raise DocumentError("; ".join(f"document {r['id']}: {r['problem']}" for r in bad))
    return documents


def patched(documents: DataFrame, sets: Mapping[str, object], removes: Sequence[str] = (), column: str = "document") -> DataFrame:
    """Documents with values set and removed at pointers whose parents exist; Arrow batches of JSON text."""

    def parts(pointer: str) -> list[str]:
        json_path(pointer)
        return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]

    plan = [(parts(p), True, v) for p, v in sets.items()] + [(parts(p), False, None) for p in removes]

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        value = json.loads(text)
        for steps, is_set, given in plan:
            new = copy.deepcopy(given)  # each document gets a value of its own
            if not steps:
                value = new if is_set else None
                continue
            at_ = value
            for s in steps[:-1]:
                at_ = at_[int(s)] if isinstance(at_, list) else at_[s]
            last = int(steps[-1]) if isinstance(at_, list) and steps[-1] != "-" else steps[-1]
            if is_set and isinstance(at_, list) and last in ("-", len(at_)):
                at_.append(new)
            elif is_set:
                at_[last] = new
            else:
                del at_[last]
        return json.dumps(value, ensure_ascii=False)

    change = F.pandas_udf(lambda s: s.map(one), T.StringType())
    return documents.withColumn(column, F.parse_json(change(F.to_json(F.col(column)))))
