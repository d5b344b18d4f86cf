import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import json_path
from millrace.sources import documents as d

ROWS = [
    (1, '{"mode":"dark","choice":null,"n":1}'),
    (2, '{"mode":"light","n":2.5,"list":[1,{"a/b":3}]}'),
    (3, '{"x.y":[{"up/down":null,"w~":false}]}'),
    (4, '{"mode":7}'),
    (5, '"text"'),
    (6, '{"mode":"x","more":1}'),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, j string").select("id", F.parse_json("j").alias("document"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("conditions", "want"),
    [
        ([d.Equal("/mode", "dark")], [1]),
        ([d.Equal("/choice", None)], [1]),
        ([d.Missing("/choice")], [2, 3, 4, 5, 6]),
        ([d.Missing("/choice"), d.Missing("/mode")], [3, 5]),
        ([d.Equal("/list", [1, {"a/b": 3}])], [2]),
        ([d.Equal("/list/1/a~1b", 3)], [2]),
        ([d.Equal("/x.y/0/w~0", False)], [3]),
        ([d.Equal("/x.y/0/up~1down", None)], [3]),
        ([d.Equal("", "text")], [5]),
        ([], [1, 2, 3, 4, 5, 6]),
    ],
)
def test_conditions(docs, conditions, want):
    assert ids(d.select(docs, conditions, [])) == want


def test_projection_leaves_missing_out(docs):
    got = {r["id"]: r["fields"] for r in d.select(docs, [], [("m", "/mode"), ("c", "/choice"), ("l", "/list/0")]).collect()}
    assert got[1] == {"m": '"dark"', "c": "null"} and got[2] == {"m": '"light"', "l": "1"} and got[5] == {}
    with pytest.raises(d.DocumentError):
        d.select(docs, [], [("m", "/mode"), ("m", "/n")])


def test_pointers():
    assert json_path("/x.y/0/up~1down") == "$['x.y'][0]['up/down']" and json_path("") == "$"
    with pytest.raises(ValueError, match="pointer"):
        json_path("a")


def test_pointer_into_a_scalar(docs):
    assert ids(docs.filter(d.through_scalar(F.col("document"), "/mode/x"))) == [1, 2, 4, 5, 6]
    assert ids(docs.filter(d.through_scalar(F.col("document"), "/list/0/x"))) == [2, 5]


def test_shapes_agree(spark, docs):
    flat = d.obj(mode=d.TEXT, choice=(d.nullable(d.TEXT), False), n=(d.NUMBER, False))
    assert d.flat(flat)
    found = {r["id"]: r["problem"] for r in d.violations(docs, flat).collect()}
    by_hand = {i: d.problem(flat, __import__("json").loads(t)) for i, t in ROWS}
    assert found == {i: p for i, p in by_hand.items() if p}
    assert found == {2: "unknown /list", 3: "missing /mode", 4: "kind /mode", 5: "kind /", 6: "unknown /more"}
    deep = d.obj(**{"x.y": d.array(d.mapping(d.nullable(d.BOOL)))})
    assert 3 not in {r["id"] for r in d.violations(docs, deep).collect()}
    wrong = d.obj(**{"x.y": d.array(d.mapping(d.BOOL))})
    assert {r["id"]: r["problem"] for r in d.violations(docs, wrong).collect()}[3] == "kind /x.y/0/up~1down"


def test_widening():
    base = d.obj(theme=d.TEXT)
    assert d.widens(base, d.obj(theme=d.TEXT, size=(d.nullable(d.NUMBER), False)))
    assert d.widens(base, d.obj(theme=d.nullable(d.TEXT))) and d.widens(base, d.ANY)
    assert not d.widens(base, d.obj(theme=d.TEXT, size=d.NUMBER))
    assert not d.widens(base, d.obj(theme=d.NUMBER)) and not d.widens(d.nullable(d.TEXT), d.TEXT)


def test_revisions(spark, docs):
    heads = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "collection string, id long, token string")
    edits = spark.createDataFrame([(1, "a", "a2"), (1, "a", "a1"), (2, "old", "x")], "id long, base string, token string")
    moved, lost = d.revise(heads, edits)
    assert {r["id"]: r["token"] for r in moved.collect()} == {1: "a1", 2: "b"}
    assert sorted((r["id"], r["token"]) for r in lost.collect()) == [(1, "a2"), (2, "x")]
    payloads = spark.createDataFrame([(1, "a1", "new"), (1, "a", "old"), (2, "b", "two")], "id long, token string, document string")
    assert {r["id"]: r["document"] for r in d.current(moved, payloads).collect()} == {1: "new", 2: "two"}
    assert [r["id"] for r in d.inventory(docs, heads).collect()] == [1, 2]


def test_lifecycle(spark):
    docs = lambda rows: spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("document"))
    heads, payloads = spark.createDataFrame([], "collection string, id long, token string"), docs([]).select("id", F.lit("").alias("token"), "document")
    shape = d.obj(theme=d.TEXT, size=(d.NUMBER, False))
    fresh = docs([(1, '{"theme":"a"}'), (2, '{"theme":5}'), (3, '{"theme":"b","size":1}'), (4, "{}"), (4, "{}")]).withColumn("collection", F.lit("c"))
    heads, payloads, refused = d.create(heads, payloads, fresh, shape)
    assert ids(heads) == [1, 3] and {r["id"]: r["problem"] for r in refused.collect()} == {2: "kind /theme", 4: "id given twice"}
    assert {r["problem"] for r in d.create(heads, payloads, fresh.filter("id = 1"), shape)[2].collect()} == {"id exists"}
    old = {r["id"]: r["token"] for r in heads.collect()}
    edits = spark.createDataFrame([(1, old[1]), (1, old[1]), (3, "stale"), (9, "none")], "id long, base string")
    after, more, refused = d.edit(heads, payloads, edits, shape, {"/size": 7})
    assert ids(refused) == [3, 9] and more.count() == 3
    now = {r["id"]: r["j"] for r in d.current(after, more).select("id", F.to_json("document").alias("j")).collect()}
    assert now == {1: '{"size":7,"theme":"a"}', 3: '{"size":1,"theme":"b"}'}
    same, _, refused = d.edit(heads, payloads, edits.filter("id = 1"), shape, {"/theme": 1})
    assert {r["problem"] for r in refused.collect()} == {"kind /theme"} and sorted(map(tuple, same.collect())) == sorted(map(tuple, heads.collect()))
    left, lost = d.end(after, spark.createDataFrame([(1, old[1]), (3, old[3])], "id long, token string"))
    assert ids(left) == [1] and ids(lost) == [1]
    held = d.current(after, more)
    assert d.evolve(held, shape, d.obj(theme=d.TEXT, size=(d.NUMBER, False), extra=(d.nullable(d.TEXT), False))) is held
    for bad in (d.obj(theme=d.TEXT), d.obj(theme=d.TEXT, size=(d.NUMBER, False), need=d.TEXT)):
        with pytest.raises(d.DocumentError):
            d.evolve(held, shape, bad)
    with pytest.raises(d.DocumentError, match="document"):
        d.evolve(docs([(1, '{"theme":null}')]), shape, shape)


def test_patches(docs):
    got = {r["id"]: r["j"] for r in d.patched(docs.filter("id = 2"), {"/list/1/a~1b": None, "/list/-": "end", "/new": {"k": 1}}, ["/mode"]).select("id", F.to_json("document").alias("j")).collect()}
    assert got[2] == '{"list":[1,{"a/b":null},"end"],"n":2.5,"new":{"k":1}}'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    """Heads, payloads and new documents in files, whose bytes are few for their rows."""

    def kept(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    made = lambda rows: spark.createDataFrame(rows, "collection string, id long, token string, j string").withColumn("document", F.parse_json("j"))
    old, new = made([("c", i, f"t{i}", '{"k":1}') for i in range(8)]), made([("c", i, None, '{"k":2}') for i in range(6, 12)] + [("c", None, None, '{"k":3}')])
    return kept(old.select("collection", "id", "token"), "heads"), kept(old.select("id", "token", "document"), "payloads"), kept(new.select("collection", "id", "document"), "fresh")


def test_creation_broadcasts_no_table_and_loses_no_row(stored):
    heads, payloads, fresh = stored
    heads, payloads, refused = d.create(heads, payloads, fresh, d.obj(k=d.NUMBER))
    for df in (heads, payloads, refused, d.current(heads, payloads)):
        assert "BroadcastExchange" not in plan(df)
    assert ids(heads) == list(range(12)) and {r["id"]: r["problem"] for r in refused.collect()} == {6: "id exists", 7: "id exists", None: "id is absent"}


def test_edits_and_ends_broadcast_no_table(stored):
    heads, payloads, _ = stored
    edits = heads.filter("id > 2").select("id", F.when(F.col("id") == 7, F.lit("old")).otherwise(F.col("token")).alias("base"))
    heads, payloads, refused = d.edit(heads, payloads, edits, d.obj(k=d.NUMBER), {"/k": 5})
    left, lost = d.end(heads, heads.filter("id > 5").select("id", F.when(F.col("id") == 6, F.col("token")).otherwise(F.lit("old")).alias("token")))
    for df in (heads, payloads, refused, left, lost):
        assert "BroadcastExchange" not in plan(df)
    assert ids(refused) == [7] and payloads.count() == 12 and ids(left) == [0, 1, 2, 3, 4, 5, 7] and ids(lost) == [7]
    assert {r["id"] for r in heads.collect() if r["token"] != f"t{r['id']}"} == {3, 4, 5, 6}
