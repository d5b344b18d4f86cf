import pytest

from millrace.operators import graph
from millrace.operators.query import form, selected
from millrace.sources.schema import Entity, Field, Reference, Relation, Schema
from worlds import forge, ids, world

TREE = Schema(
    (
        Entity("Org", (Field("name"),)),
        Entity("Repo", (Field("name"),), (Reference("org", "Org", owner=True),)),
        Entity("Branch", (Field("name"),), (Reference("repo", "Repo", owner=True),)),
        Entity("Note", (Field("name"),), (Reference("branch", "Branch", optional=True),)),
        Entity("Star", (Field("name"),), relations=(Relation("branches", "Branch"),)),
    )
)


def tree(spark, notes=(), stars=(), edges=()):
    return world(
        spark,
        TREE,
        {
            "Org": [{"id": 1}, {"id": 2}],
            "Repo": [{"id": 1, "org_id": 1}, {"id": 2, "org_id": 1, "expires_at": 5}, {"id": 3, "org_id": 2}],
            "Branch": [{"id": 1, "repo_id": 1}, {"id": 2, "repo_id": 2}, {"id": 3, "repo_id": 1}],
            "Note": list(notes),
            "Star": list(stars),
        },
        {"Star.branches": list(edges)},
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 2), (5, 1)], "left long, right long")
    reach = graph.closure(edges)
    assert rows(reach) == sorted([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 1), (5, 2), (5, 3), (5, 4)])
    asked = spark.createDataFrame([(4, 1), (1, 4), (6, 6), (4, 5)], "left long, right long")
    assert rows(graph.closes_cycle(reach, asked)) == [(4, 1), (4, 5), (6, 6)]


def test_closure_keeps_ids(spark):
    before = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 3)], "id long, left long, right long")
    now, ended = graph.closure_changes(before, spark.createDataFrame([(1, 2), (1, 4)], "left long, right long"), 10)
    assert rows(now) == [(1, 1, 2), (10, 1, 4)] and sorted(ids(ended)) == [2, 3]


def test_numbered_is_gapless(spark):
    out = graph.numbered(spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as k"), ["k"], 5).orderBy("k").collect()
    assert [(r["id"], r["k"]) for r in out] == [(k + 5, k) for k in range(1000)]


def test_owner_chain_ends_at_dead_owners(spark):
    got = rows(graph.owner_chain(tree(spark), "Branch"))
    assert got == sorted([(1, 0, "Branch", 1), (1, 1, "Repo", 1), (1, 2, "Org", 1), (2, 0, "Branch", 2), (3, 0, "Branch", 3), (3, 1, "Repo", 1), (3, 2, "Org", 1)])


def test_cascade(spark):
    w = tree(spark)
    reached = graph.frontier(w, "Org", w.point("Org", 1).select("id"))
    assert rows(reached) == sorted([("Org", 0, 1), ("Repo", 1, 1), ("Branch", 2, 1), ("Branch", 2, 3)])
    assert rows(graph.frontier_counts(reached)) == [("Branch", 2), ("Org", 1), ("Repo", 1)]
    after = graph.cascade(w, "Org", w.point("Org", 1).select("id"))
    assert {(r["id"], r["expires_at"]) for r in after["Branch"].collect()} == {(1, 1000), (2, None), (3, 1000)}


@pytest.mark.parametrize(
    ("notes", "stars", "edges", "blocked"),
    [
        ([{"id": 1, "branch_id": 1}], [], [], True),
        ([{"id": 1, "branch_id": 1, "expires_at": 9}], [], [], False),
        ([{"id": 1, "branch_id": None}], [], [], False),
        ([], [{"id": 1}], [{"id": 1, "left": 1, "right": 3}], True),
        ([], [{"id": 1, "expires_at": 9}], [{"id": 1, "left": 1, "right": 3}], False),
        ([], [{"id": 1}], [{"id": 1, "left": 1, "right": 3, "expires_at": 9}], False),
    ],
)
def test_holders_block_a_cascade(spark, notes, stars, edges, blocked):
    w = tree(spark, notes, stars, edges)
    roots = w.point("Org", 1).select("id")
    assert (graph.blocking_holders(w, graph.frontier(w, "Org", roots)).count() > 0) == blocked
    if blocked:
        with pytest.raises(graph.GraphError):
            graph.cascade(w, "Org", roots)


def test_holders_are_judged_at_the_end_time(spark):
    w = tree(spark, notes=[{"id": 1, "branch_id": 1, "expires_at": 1_500}])
    roots = w.point("Org", 1).select("id")
    assert graph.blocking_holders(w, graph.frontier(w, "Org", roots, 1_200), 1_200).count() == 1
    assert graph.blocking_holders(w, graph.frontier(w, "Org", roots, 2_000), 2_000).count() == 0


def test_retention(spark):
    w = tree(spark, stars=[{"id": 1, "expires_at": 50}, {"id": 2, "expires_at": 60}], edges=[{"id": 7, "left": 1, "right": 1}, {"id": 8, "left": 1, "right": 3, "expires_at": 99}])
    assert sorted(ids(graph.collectable_rows(w, "Star", 70))) == [2]
    assert ids(graph.collectable_rows(w, "Repo", 70)) == []  # a live branch points to it
    assert sorted(ids(graph.collectable_edges(w, "Star", "branches", 70))) == [7, 8]
    assert ids(graph.collectable_edges(w, "Star", "branches", 70, batch=1)) == [7]


def test_uniqueness(spark):
    w = forge(spark)
    fresh = w.tables["Repo"].filter("id = 2").selectExpr("9 as id", "'x' as name", "visibility", "owner_id", "expires_at", "created_at", "updated_at")
    assert ids(graph.taken(w.tables["Repo"], fresh, "name", ["owner_id"])) == [9]
    assert rows(graph.duplicates(w.tables["Repo"], "visibility")) == [("private", 2)]
    leased = w.tables["Repo"].selectExpr("id", "name", "visibility", "owner_id", "5000L as expires_at", "created_at", "updated_at")
    assert graph.taken(leased, fresh, "name", ["owner_id"]).count() == 0
    assert rows(graph.shared_targets(w.tables["Repo"], "owner_id")) == [(1, 2)]
    assert selected(w, form("Repo")).count() == 3
