from dataclasses import replace

import pytest

from millrace.operators import evolve
from millrace.sources.schema import Entity, Field, Reference, Relation, Schema, SchemaError
from worlds import FORGE, SCHOOL, ids, school, world


def test_manifest_round_trip():
    for s in (SCHOOL, FORGE):
        assert Schema.read(s.manifest()) == replace(s, entities=tuple(sorted(s.entities, key=lambda e: e.name)))
    with pytest.raises(SchemaError):
        Schema.read(SCHOOL.manifest().replace(":", ": ", 1))
    assert ("relation", "Student", "courses") in {r[:3] for r in SCHOOL.rows()}


@pytest.mark.parametrize(
    "entities",
    [
        (Entity("A"), Entity("A")),
        (Entity("A", (Field("id"),)),),
        (Entity("A", references=(Reference("b", "B"),)),),
        (Entity("A", references=(Reference("x", "A", owner=True), Reference("y", "A", owner=True))),),
        (Entity("A", references=(Reference("x", "A", owner=True, optional=True),)),),
        (Entity("A", (Field("n", optional=True), Field("m", unique=("n",)))),),
        (Entity("A", (Field("n", "float"),)),),
        (Entity("A"), Entity("B", relations=(Relation("r", "A", closure=True),))),
    ],
)
def test_impossible_schemas(entities):
    with pytest.raises(SchemaError):
        Schema(entities)


def test_names():
    s = Schema((Entity("Tag"), Entity("TAG"), Entity("Other", relations=(Relation("Kids", "Other", closure=True),))))
    assert s.entity("Tag").name == "Tag" and s.entity("other").relation("kids_CLOSURE").name == "Kids_closure"
    with pytest.raises(SchemaError):
        s.entity("tag")


def _school_with(**swap):
    e = SCHOOL.entity("Student")
    fields = tuple(replace(f, **swap.get(f.name, {})) for f in e.fields)
    return SCHOOL.with_entity(replace(e, fields=fields))


def test_steps_and_needs(spark):
    w = school(spark)
    assert evolve.difference(SCHOOL, SCHOOL) == []
    cases = [
        ({"points": {"kind": "text"}}, []),
        ({"no": {"kind": "int"}}, [("cast", "values")]),
        ({"name": {"optional": False}}, [("alter", "present")]),
        ({"name": {"optional": False, "default": "-"}}, []),
        ({"points": {"unique": ()}}, []),
        ({"points": {"low": 0}}, [("alter", "values")]),
        ({"points": {"low": -5}}, []),
    ]
    for swap, want in cases:
        got = evolve.unmet(SCHOOL, _school_with(**swap), w.tables, w.now)
        assert [(s.action, n) for s, n in got] == want, swap
    with pytest.raises(evolve.EvolutionError):
        evolve.difference(SCHOOL, _school_with(passed={"kind": "link"}))
    fewer = Schema((SCHOOL.entity("Course"),))
    assert [n for _, n in evolve.unmet(SCHOOL, fewer, w.tables, w.now)] == ["authority"]
    assert evolve.unmet(SCHOOL, fewer, w.tables, w.now, authority=True) == []


def test_generation_copy(spark):
    w = school(spark)
    new = _school_with(points={"kind": "text"}, passed={"kind": "int"}, name={"optional": False, "default": "?"})
    tables, edges = evolve.generation(SCHOOL, new, dict(w.tables), dict(w.edges), w.now)
    rows = {r["id"]: r for r in tables["Student"].collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[1]["points"] == "7" and rows[2]["passed"] == 0 and rows[3]["name"] == "?"
    assert sorted(ids(edges["Student.courses"])) == [10, 11, 12, 14]
    assert evolve.drifted(new, tables) == [] and evolve.drifted(SCHOOL, tables) == ["Student"]
    assert sorted(ids(evolve.dropped_keys(w.tables["Student"], tables["Student"]))) == [5]
    assert sorted(ids(evolve.kept_keys(w.tables["Student"], tables["Student"]))) == [1, 2, 3, 4]


def test_outbox_names_what_is_gone(spark):
    w = school(spark)
    e = SCHOOL.entity("Student")
    new = SCHOOL.with_entity(replace(e, fields=tuple(f for f in e.fields if f.name != "name")))
    after = {"Course": w.tables["Course"], "Student": evolve.copied(e, new.entity("Student"), w.tables["Student"], w.now)}
    got = sorted((r["entity"], r["field"] or "", r["key"]) for r in evolve.outbox(SCHOOL, new, dict(w.tables), after).collect())
    assert got == [("Student", "", 5), ("Student", "name", 1), ("Student", "name", 2), ("Student", "name", 4)]


def test_rename_is_of_a_leaf_alone():
    e = SCHOOL.entity("Student")
    new = Schema((SCHOOL.entity("Course"), replace(e, name="Pupil")))
    assert evolve.renamed(SCHOOL, new) == ("Student", "Pupil")
    assert evolve.renamed(SCHOOL, Schema((replace(SCHOOL.entity("Course"), name="Class"), e.__class__(e.name, e.fields)))) is None


def test_text_casts_need_canonical_integers(spark):
    s = Schema((Entity("N", (Field("t", optional=True),)),))
    w = world(spark, s, {"N": [{"id": k, "t": t} for k, t in enumerate(["0", "-7", "+7", "007", " 7", "9223372036854775808", None, "x"])]})
    assert sorted(ids(evolve.cast_failures(w.rows("N"), "t", "text", "int"))) == [2, 3, 4, 5, 7]
    assert sorted(ids(evolve.cast_failures(w.rows("N"), "t", "text", "bool"))) == [0, 1, 2, 3, 4, 5, 7]
    assert evolve.clocks(w.tables).first()["last"] == 7


def test_declared_classes():
    from millrace.sources.declare import Resource, boolean, integer, link, owner, reference, relation, schema_of, serial, text

    class Org(Resource, hidden=True):
        name = text(unique=())

    class Repo(Resource, frozen=True):
        name = text(unique=("org_id",))
        no = serial("org_id")
        size = integer(optional=True, low=0)
        page = link(optional=True)
        open = boolean(default=True)
        org = owner("Org")
        fork = reference("Repo", optional=True)
        stars = relation("Org", weight=integer())
        parts = relation("Repo", closure=True)

    s = schema_of(Org, Repo)
    e = s.entity("Repo")
    assert [f.name for f in e.fields] == ["name", "no", "size", "page", "open"] and e.frozen and s.entity("Org").hidden
    assert e.owner.column == "org_id" and e.relation("stars").fields == (Field("weight", "int"),) and e.relation("parts_closure").target == "Repo"
    assert Schema.read(s.manifest()).digest() == s.digest()
