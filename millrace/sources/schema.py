"""Declared entities: fields, references and relations, and their manifest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

VERSION = 1
KINDS = {"text": T.StringType(), "link": T.StringType(), "int": T.LongType(), "bool": T.BooleanType()}
SYSTEM = ("id", "expires_at", "created_at", "updated_at")


class SchemaError(ValueError):
    """A schema that can't be, or a name that isn't in it."""


@dataclass(frozen=True)
class Field:
    """A typed field with its uniqueness, default, domain and range.

    ``unique`` is None, () for uniqueness over the table, or the fields and
    references within whose values it holds. ``serial`` fields count up within
    these scopes.
    """

    name: str
    kind: str = "text"
    optional: bool = False
    unique: tuple[str, ...] | None = None
    serial: tuple[str, ...] | None = None
    default: str | int | bool | None = None
    values: tuple | None = None
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Reference:
    """A many-to-one reference; ``owner`` references make the target a cascade parent."""

    name: str
    target: str
    owner: bool = False
    optional: bool = False
    exclusive: bool = False

    @property
    def column(self) -> str:
        return f"{self.name}_id"


@dataclass(frozen=True)
class Relation:
    """A many-to-many relation with fields on its edges.

    ``membership`` relations say who belongs to a group; ``closure`` relations of
    an entity with itself come with their transitive closure.
    """

    name: str
    target: str
    fields: tuple[Field, ...] = ()
    membership: bool = False
    closure: bool = False


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...] = ()
    references: tuple[Reference, ...] = ()
    relations: tuple[Relation, ...] = ()
    frozen: bool = False
    hidden: bool = False

    @property
    def owner(self) -> Reference | None:
        return next((r for r in self.references if r.owner), None)

    def kind(self, name: str) -> str:
        """The kind of a field, of a reference's column or of a system column."""
        if name in SYSTEM:
            return "int"
        for f in self.fields:
            if f.name == name:
                return f.kind
        if any(r.column == name for r in self.references):
            return "int"
        raise SchemaError(f"{self.name} has no field {name!r}")

    def relation(self, name: str) -> Relation:
        """A relation by its name in any case; ``<name>_closure`` is derived from closure relations."""
        for r in self.relations:
            if r.name.lower() == name.lower():
                return r
            if r.closure and f"{r.name}_closure".lower() == name.lower():
                return Relation(f"{r.name}_closure", r.target)
        raise SchemaError(f"{self.name} has no relation {name!r}")

    def struct(self) -> T.StructType:
        own = [T.StructField(f.name, KINDS[f.kind]) for f in self.fields]
        refs = [T.StructField(r.column, T.LongType()) for r in self.references]
        ends = [T.StructField(n, T.LongType()) for n in SYSTEM[1:]]
        return T.StructType([T.StructField("id", T.LongType(), False), *own, *refs, *ends])


def edge_struct(relation: Relation) -> T.StructType:
    own = [T.StructField(f.name, KINDS[f.kind]) for f in relation.fields]
    ends = [T.StructField(n, T.LongType()) for n in SYSTEM[1:]]
    key = [T.StructField(n, T.LongType(), False) for n in ("id", "left", "right")]
    return T.StructType([*key, *own, *ends])


@dataclass(frozen=True)
class Schema:
    entities: tuple[Entity, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [e.name for e in self.entities]
        if len(set(names)) != len(names):
            raise SchemaError("two entities of one name")
        for e in self.entities:
            own = [*(f.name for f in e.fields), *(r.column for r in e.references)]
            if len(set(own)) != len(own) or set(own) & set(SYSTEM):
                raise SchemaError(f"{e.name} repeats a column")
            if sum(r.owner for r in e.references) > 1 or any(r.owner and r.optional for r in e.references):
                raise SchemaError(f"{e.name} must have one required owner at most")
            if sum(r.membership for r in e.relations) > 1:
                raise SchemaError(f"{e.name} has two membership relations")
            for r in (*e.references, *e.relations):
                if r.target not in names:
                    raise SchemaError(f"{e.name}.{r.name} points to no entity")
            if any(r.closure and r.target != e.name for r in e.relations):
                raise SchemaError(f"a closure of {e.name} must relate it to itself")
            required = {f.name for f in e.fields if not f.optional} | {r.column for r in e.references if not r.optional}
            for f in e.fields:
                if f.kind not in KINDS:
                    raise SchemaError(f"{e.name}.{f.name} has no kind {f.kind!r}")
                if set(f.unique or ()) - required or set(f.serial or ()) - required:
                    raise SchemaError(f"the scopes of {e.name}.{f.name} must be required")

    def entity(self, name: str) -> Entity:
        """An entity by its name, or by its name in any case if that is one entity's."""
        for e in self.entities:
            if e.name == name:
                return e
        found = [e for e in self.entities if e.name.lower() == name.lower()]
        if len(found) > 1:
            raise SchemaError(f"{name!r} is ambiguous")
        if not found:
            raise SchemaError(f"no entity {name!r}")
        return found[0]

    def with_entity(self, entity: Entity) -> Schema:
        return replace(self, entities=(*(e for e in self.entities if e.name != entity.name), entity))

    # ---- manifest

    def manifest(self) -> str:
        """Canonical JSON: sorted keys, no blanks; reading it back writes the same bytes."""
        body = {"version": VERSION, "entities": sorted((asdict(e) for e in self.entities), key=lambda e: e["name"])}
        return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.manifest().encode()).hexdigest()

    @staticmethod
    def read(manifest: str) -> Schema:
        body = json.loads(manifest)
        if body.get("version") != VERSION or set(body) != {"version", "entities"}:
            raise SchemaError("not a manifest of this version")
        tuples = lambda d, *keys: {k: tuple(v) if k in keys and v is not None else v for k, v in d.items()}
        fields = lambda some: tuple(Field(**tuples(f, "unique", "serial", "values")) for f in some)
        out = Schema(
            tuple(
                Entity(
                    **{
                        **e,
                        "fields": fields(e["fields"]),
                        "references": tuple(Reference(**r) for r in e["references"]),
                        "relations": tuple(Relation(**{**r, "fields": fields(r["fields"])}) for r in e["relations"]),
                    }
                )
                for e in body["entities"]
            )
        )
        if out.manifest() != manifest:
            raise SchemaError("the manifest is not canonical")
        return out

    def rows(self) -> list[tuple[str, str, str, str]]:
        """The schema as rows (part, entity, name, detail), for storing it as a table."""
        out = []
        for e in self.entities:
            out.append(("entity", e.name, e.name, json.dumps({"frozen": e.frozen, "hidden": e.hidden}, sort_keys=True)))
            for kind, some in (("field", e.fields), ("reference", e.references), ("relation", e.relations)):
                out += [(kind, e.name, x.name, json.dumps(asdict(x), sort_keys=True)) for x in some]
        return out
