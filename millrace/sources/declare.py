"""Entities declared as classes.

    class Course(Resource):
        code = text(unique=())

    class Student(Resource, frozen=True):
        name = text()
        points = integer(optional=True, low=0)
        home = reference("Room", optional=True)
        courses = relation("Course", grade=text())

    schema = schema_of(Course, Student)
"""

from __future__ import annotations

from dataclasses import replace

from .schema import Entity, Field, Reference, Relation, Schema


def _field(kind: str, **rules) -> Field:
    return Field("", kind, **rules)


def text(**rules) -> Field:
    return _field("text", **rules)


def link(**rules) -> Field:
    return _field("link", **rules)


def integer(**rules) -> Field:
    return _field("int", **rules)


def boolean(**rules) -> Field:
    return _field("bool", **rules)


def serial(*scopes: str) -> Field:
    """A counter within the values of ``scopes``."""
    return Field("", "int", serial=scopes)


def reference(target: str, **rules) -> Reference:
    return Reference("", target, **rules)


def owner(target: str) -> Reference:
    """A required reference to the row that owns this one."""
    return Reference("", target, owner=True)


def relation(target: str, membership: bool = False, closure: bool = False, **fields: Field) -> Relation:
    return Relation("", target, tuple(replace(f, name=n) for n, f in fields.items()), membership, closure)


class Resource:
    """Base of declared entities; its subclass's attributes become fields, references and relations in their order."""

    entity: Entity

    def __init_subclass__(cls, frozen: bool = False, hidden: bool = False):
        parts = {Field: [], Reference: [], Relation: []}
        for name, value in list(vars(cls).items()):
            if type(value) in parts:
                parts[type(value)].append(replace(value, name=name))
        cls.entity = Entity(cls.__name__, *(tuple(parts[k]) for k in (Field, Reference, Relation)), frozen, hidden)


def schema_of(*resources: type[Resource]) -> Schema:
    return Schema(tuple(r.entity for r in resources))
