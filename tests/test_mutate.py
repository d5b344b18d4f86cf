import pytest

from millrace.operators import mutate
from millrace.sources.schema import Entity, Field, Relation, Schema
from worlds import forge, ids, school, world

JOB = Schema((Entity("Job", (Field("state", default="queued", values=("queued", "done")), Field("attempts", "int", default=0, low=0, high=2), Field("label", optional=True, unique=()))),))


def job(spark):
    return world(spark, JOB, {"Job": [{"id": 1, "state": "done", "attempts": 1, "label": "a"}, {"id": 2, "state": "done", "attempts": 1, "label": "b", "expires_at": 9_000}]})


def test_insert_fills_defaults_and_counts_ids(spark):
    values = spark.createDataFrame([("x",), (None,)], "label string")
    batch = mutate.insert(job(spark), "Job", values, 10)
    new = {r["id"]: r for r in batch.tables["Job"].filter("id >= 10").collect()}
    assert sorted(new) == [10, 11] and {r["state"] for r in new.values()} == {"queued"} and {r["created_at"] for r in new.values()} == {1000}
    assert sorted(tuple(r) for r in batch.changes().collect()) == [("put", "Job", 10), ("put", "Job", 11)]


@pytest.mark.parametrize("row", [("running", 0, None), ("done", 3, None), ("done", -1, None), ("done", 0, "a"), ])
def test_insert_refuses(spark, row):
    with pytest.raises(mutate.Refused):
        mutate.insert(job(spark), "Job", spark.createDataFrame([row], "state string, attempts long, label string"), 10)


def test_a_leased_row_holds_no_key(spark):
    batch = mutate.insert(job(spark), "Job", spark.createDataFrame([("b",)], "label string"), 10)
    assert batch.tables["Job"].count() == 3
    with pytest.raises(mutate.Refused):
        mutate.insert(job(spark), "Job", spark.createDataFrame([("c",), ("c",)], "label string"), 10)


def test_update_and_unset(spark):
    w = job(spark)
    batch = mutate.update(w, "Job", spark.createDataFrame([(1, 2)], "id long, attempts long"), unset=("label",))
    row = batch.tables["Job"].filter("id = 1").first()
    assert (row["attempts"], row["label"], row["updated_at"], row["state"]) == (2, None, 1000, "done")
    for bad, unset in (([(1, 9)], ()), ([(7, 1)], ()), ([(1, 1)], ("state",))):
        with pytest.raises(mutate.Refused):
            mutate.update(w, "Job", spark.createDataFrame(bad, "id long, attempts long"), unset=unset)


def test_references_and_serials(spark):
    w = forge(spark)
    values = spark.createDataFrame([("five", 1, 3), ("six", 1, 3), ("seven", 2, 1)], "title string, repo_id long, author_id long")
    rows = mutate.insert(w, "Issue", values, 10).tables["Issue"].filter("id >= 10").collect()
    assert sorted((r["repo_id"], r["no"]) for r in rows) == [(1, 3), (1, 4), (2, 2)]
    with pytest.raises(mutate.Refused):
        mutate.insert(w, "Issue", spark.createDataFrame([("x", 77, 3)], "title string, repo_id long, author_id long"), 10)
    with pytest.raises(mutate.Refused):
        mutate.insert(w, "Repo", spark.createDataFrame([("x", "public", 1)], "name string, visibility string, owner_id long"), 10)
    assert mutate.insert(w, "Repo", spark.createDataFrame([("x", "public", 3)], "name string, visibility string, owner_id long"), 10).tables["Repo"].count() == 4


def test_edges(spark):
    w = school(spark)
    pairs = spark.createDataFrame([(3, 1, "D"), (3, 2, "E")], "left long, right long, grade string")
    edges = mutate.connect(w, "Student", "courses", pairs, 100).edges["Student.courses"]
    assert sorted(ids(edges.filter("id >= 100"))) == [100, 101]
    for bad in ([(1, 1, "x")], [(3, 3, "x")], [(5, 1, "x")], [(3, 2, "x"), (3, 2, "y")]):
        with pytest.raises(mutate.Refused):
            mutate.connect(w, "Student", "courses", spark.createDataFrame(bad, "left long, right long, grade string"), 100)
    tuned = mutate.tune(w, "Student", "courses", spark.createDataFrame([(10, "Z")], "id long, grade string")).edges["Student.courses"]
    assert tuned.filter("id = 10").first()["grade"] == "Z" and tuned.filter("id = 12").first()["grade"] == "B"
    cut = mutate.disconnect(w, "Student", "courses", spark.createDataFrame([(10,)], "id long")).edges["Student.courses"]
    assert cut.filter("id = 10").first()["expires_at"] == 1000


def test_closure_edges_refuse_cycles(spark):
    schema = Schema((Entity("Actor", (Field("name", optional=True),), relations=(Relation("members", "Actor", closure=True),)),))
    w = world(spark, schema, {"Actor": [{"id": k} for k in range(1, 5)]}, {"Actor.members": [{"id": 1, "left": 1, "right": 2}, {"id": 2, "left": 2, "right": 3}]})
    for bad in ([(3, 1)], [(4, 4)], [(3, 4), (4, 1)]):
        with pytest.raises(mutate.Refused):
            mutate.connect(w, "Actor", "members", spark.createDataFrame(bad, "left long, right long"), 10)
    assert mutate.connect(w, "Actor", "members", spark.createDataFrame([(1, 4)], "left long, right long"), 10).edges["Actor.members"].count() == 3


def test_rows_without_a_scope_count_among_themselves(spark):
    own = Entity("Item", (Field("no", "int", serial=("box",)), Field("box")))
    fresh = spark.createDataFrame([(k, None if k % 2 else "b", None) for k in range(8)], "id long, box string, no long")
    old = spark.createDataFrame([(100, None, 5), (101, "c", 9)], "id long, box string, no long")
    got = {r["id"]: r["no"] for r in mutate.with_serials(own, fresh, old).collect()}
    assert got == {0: 1, 2: 2, 4: 3, 6: 4, 1: 6, 3: 7, 5: 8, 7: 9}


def test_changes_name_live_rows_and_edges_once(spark):
    w, one = school(spark), lambda rows, schema: spark.createDataFrame(rows, schema)
    bad = [
        lambda: mutate.update(w, "Student", one([(1, 2), (1, 3)], "id long, points long")),
        lambda: mutate.lease(w, "Student", one([(5, 9)], "id long, expires_at long")),
        lambda: mutate.lease(w, "Student", one([(1, 9), (1, 8)], "id long, expires_at long")),
        lambda: mutate.tune(w, "Student", "courses", one([(10, "a"), (10, "b")], "id long, grade string")),
        lambda: mutate.tune(w, "Student", "courses", one([(13, "a")], "id long, grade string")),
        lambda: mutate.tune(w, "Student", "courses", one([(11, "a")], "id long, grade string")),  # its right row ended
        lambda: mutate.tune(w, "Student", "courses", one([(10,)], "id long")),
        lambda: mutate.disconnect(w, "Student", "courses", one([(99,)], "id long")),
        lambda: mutate.disconnect(w, "Student", "courses", one([(10,), (10,)], "id long")),
    ]
    for change in bad:
        with pytest.raises(mutate.Refused):
            change()
    leased = mutate.lease(w, "Student", one([(1, 5_000)], "id long, expires_at long")).tables["Student"]
    assert {r["id"]: r["expires_at"] for r in leased.collect()} == {1: 5_000, 2: None, 3: None, 4: 2_000, 5: 1_000}


def test_frozen_entities_keep_their_rows_and_edges(spark):
    from dataclasses import replace

    w = school(spark)
    w = replace(w, schema=w.schema.with_entity(replace(w.schema.entity("Student"), frozen=True)))
    one = spark.createDataFrame([(10, "a")], "id long, grade string")
    for change in (
        lambda: mutate.tune(w, "Student", "courses", one),
        lambda: mutate.disconnect(w, "Student", "courses", one.select("id")),
        lambda: mutate.update(w, "Student", spark.createDataFrame([(1, 2)], "id long, points long")),
        lambda: mutate.connect(w, "Student", "courses", spark.createDataFrame([(3, 2, "x")], "left long, right long, grade string"), 50),
    ):
        with pytest.raises(mutate.Refused, match="frozen"):
            change()
    assert mutate.insert(w, "Student", spark.createDataFrame([("s9",)], "no string"), 50).tables["Student"].count() == 6
