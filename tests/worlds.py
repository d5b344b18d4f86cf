"""Small worlds of the kinds that the operators' tests share."""

from millrace.operators.world import World
from millrace.sources.schema import Entity, Field, Reference, Relation, Schema, edge_struct

NOW = 1_000


def world(spark, schema, rows=None, edges=None, now=NOW):
    """Rows as dicts; absent cells are null, and rows live unless they say otherwise."""
    tables, links = {}, {}
    for e in schema.entities:
        struct = e.struct()
        tables[e.name] = spark.createDataFrame([tuple(r.get(c.name) for c in struct) for r in (rows or {}).get(e.name, [])], struct)
        for r in e.relations:
            struct = edge_struct(r)
            name = f"{e.name}.{r.name}"
            links[name] = spark.createDataFrame([tuple(x.get(c.name) for c in struct) for x in (edges or {}).get(name, [])], struct)
    return World(schema, tables, links, now)


SCHOOL = Schema(
    (
        Entity("Course", (Field("code"), Field("title"))),
        Entity("Student", (Field("no"), Field("name", optional=True), Field("points", "int", optional=True), Field("passed", "bool", optional=True)), relations=(Relation("courses", "Course", (Field("grade"),)),)),
    )
)


def school(spark):
    return world(
        spark,
        SCHOOL,
        {
            "Course": [
                {"id": 1, "code": "m", "title": "Maths 100%"},
                {"id": 2, "code": "p", "title": "Physics"},
                {"id": 3, "code": "x", "title": "Ended", "expires_at": 900},
            ],
            "Student": [
                {"id": 1, "no": "s1", "name": "Ann", "points": 7, "passed": True},
                {"id": 2, "no": "s2", "name": "bob", "points": -3, "passed": False},
                {"id": 3, "no": "s3", "points": None},
                {"id": 4, "no": "s4", "name": "Zoë", "points": 7, "expires_at": 2_000},
                {"id": 5, "no": "s5", "name": "Gone", "points": 9, "expires_at": 1_000},
            ],
        },
        {
            "Student.courses": [
                {"id": 10, "left": 1, "right": 1, "grade": "A"},
                {"id": 11, "left": 1, "right": 3, "grade": "A"},
                {"id": 12, "left": 2, "right": 2, "grade": "B"},
                {"id": 13, "left": 3, "right": 1, "grade": "C", "expires_at": 500},
                {"id": 14, "left": 4, "right": 2, "grade": None},
            ]
        },
    )


FORGE = Schema(
    (
        Entity("Actor", (Field("login", unique=()),)),
        Entity("Team", (Field("name"),), relations=(Relation("members", "Actor", membership=True),)),
        Entity("Repo", (Field("name", unique=("owner_id",)), Field("visibility")), (Reference("owner", "Actor", owner=True),)),
        Entity("Issue", (Field("title"), Field("no", "int", serial=("repo_id",))), (Reference("repo", "Repo", owner=True), Reference("author", "Actor"))),
    )
)


def forge(spark):
    return world(
        spark,
        FORGE,
        {
            "Actor": [{"id": k, "login": f"a{k}"} for k in (1, 2, 3)],
            "Team": [{"id": 1, "name": "t"}, {"id": 2, "name": "dead", "expires_at": 10}],
            "Repo": [
                {"id": 1, "name": "x", "visibility": "public", "owner_id": 1},
                {"id": 2, "name": "y", "visibility": "private", "owner_id": 1},
                {"id": 3, "name": "x", "visibility": "private", "owner_id": 2},
            ],
            "Issue": [
                {"id": 1, "title": "one", "no": 1, "repo_id": 1, "author_id": 3},
                {"id": 2, "title": "two", "no": 1, "repo_id": 2, "author_id": 2},
                {"id": 3, "title": "three", "no": 1, "repo_id": 3, "author_id": 3},
                {"id": 4, "title": "four", "no": 2, "repo_id": 1, "author_id": 1},
            ],
        },
        {"Team.members": [{"id": 1, "left": 1, "right": 3}, {"id": 2, "left": 2, "right": 2}]},
    )


def ids(df):
    return [r["id"] for r in df.collect()]
