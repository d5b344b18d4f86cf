import itertools

import pytest
from pyspark.sql import functions as F

from millrace.operators.eventjoin import JoinBudget, Side, join
from millrace.sources import events as ev

TABLE = ev.EventTable("t", ("producer", "trace"), 10, "producer", ("trace",), (("ok", "bool"), ("code", "int"), ("size", "uint"), ("name", "text"), ("data", "bytes")))
RECORDS = [
    (k, f"p{k % 2}", f"trace-{k % 4}", bytes([k, 0, 255]), None if k % 3 == 0 else k % 2 == 0, -(2**63) + k, str(2**64 - 1 - k), "ü" if k % 5 else None, None)
    for k in range(40)
]


@pytest.fixture(scope="module")
def batch(spark):
    df = spark.createDataFrame(RECORDS, "t long, producer string, trace string, raw binary, ok boolean, code long, size string, name string, data binary")
    return df.withColumn("size", F.col("size").cast("decimal(20,0)"))


@pytest.fixture(scope="module")
def stored(spark, batch, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ev')}/t"
    ev.write(TABLE, batch, path)
    return path


def test_window_and_keys(spark, stored):
    rows = ev.read(spark, TABLE, stored)
    q = ev.EventQuery(2, 9, {"trace": "trace-2"}, ("trace", "t"))
    got = ev.select(TABLE, rows, q)
    assert got.columns == ["trace", "t"] and sorted(r["t"] for r in got.collect()) == [2, 6]
    assert ev.count(TABLE, rows, ev.EventQuery(9, 9)).first()[0] == 0
    assert sorted(r["raw"] for r in ev.payloads(TABLE, rows, ev.EventQuery(0, 2)).collect()) == [bytearray([0, 0, 255]), bytearray([1, 0, 255])]
    sizes = {r["t"]: int(r["size"]) for r in rows.collect()}
    assert sizes[3] == 2**64 - 4


def test_partitions_are_pruned(spark, stored):
    plan = ev.select(TABLE, ev.read(spark, TABLE, stored), ev.EventQuery(12, 15, {"producer": "p0"}, ("t",)))._jdf.queryExecution().executedPlan().toString()
    parts = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "p_slot" in parts and ">= 1" in parts and "<= 1" in parts and "p_key" in parts
    assert "raw" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("bad", [{"equals": {"code": "1"}}, {"columns": ("t", "t")}, {"columns": ()}, {"columns": ("none",)}])
def test_queries_refused(spark, stored, bad):
    with pytest.raises(ev.EventError):
        ev.select(TABLE, ev.read(spark, TABLE, stored), ev.EventQuery(**bad))


def test_parts_are_sorted_and_sound(spark, stored, batch):
    rows = ev.read(spark, TABLE, stored)
    assert ev.misplaced(TABLE, rows).isEmpty() and ev.adoptable(spark, TABLE, stored)
    narrow = ev.EventTable("t", ("producer", "trace"), 20, "producer", ("trace",), TABLE.fields)
    assert not ev.adoptable(spark, narrow, stored)
    got = {r["partition"]: (r["since"], r["until"], r["rows"]) for r in ev.summary(TABLE, rows).collect()}
    assert got["k7030-0"] == (0, 9, 5) and len(got) == 8
    by_file = {}
    for r in rows.withColumn("f", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect():
        by_file.setdefault((r["f"], r["p_key"], r["p_slot"]), []).append((r["trace"], r["t"]))
    assert all(x == sorted(x) for x in by_file.values())


def test_records_need_time_keys_and_payload(spark, batch):
    with pytest.raises(ev.EventError):
        ev.checked(TABLE, batch.drop("raw"))
    for column in ("t", "trace", "raw"):
        bad = batch.withColumn(column, F.lit(None).cast(batch.schema[column].dataType))
        with pytest.raises(Exception, match="lacks"):
            ev.checked(TABLE, bad).collect()


def test_evolution_reads_old_parts_as_nulls(spark, stored, batch):
    wide = TABLE.evolved((*TABLE.fields, ("extra", "text")))
    rows = ev.read(spark, wide, stored)
    assert rows.filter("extra is not null").isEmpty() and rows.count() == 40
    both = ev.union(rows, ev.as_stored(wide, batch.withColumn("extra", F.lit("x"))))
    assert both.filter("extra = 'x'").count() == 40 and both.count() == 80
    with pytest.raises(ev.EventError):
        TABLE.evolved(TABLE.fields[1:])


def test_budgets_and_statistics(spark, stored):
    rows = ev.read(spark, TABLE, stored)
    q = ev.EventQuery(0, 20, columns=("t", "raw"))
    assert ev.within(TABLE, rows, q).count() == 20
    for budget in (ev.Budget(candidates=19), ev.Budget(rows=19), ev.Budget(bytes=20 * 11 - 1)):
        with pytest.raises(ev.EventError):
            ev.within(TABLE, rows, q, budget)
    found, seen = ev.observed(TABLE, rows, q)
    found.collect()
    assert seen.get == {"rows": 20, "bytes": 20 * 11}
    with pytest.raises(ev.EventError):
        ev.of_source(TABLE, rows, q, "producer", "p1", allowed=False)
    assert ev.of_source(TABLE, rows, q, "producer", "p1", allowed=True).count() == 10


def test_life(spark, stored):
    rows = ev.read(spark, TABLE, stored)
    assert ev.retained(rows, TABLE, 2).count() == 20


def test_tokens(spark):
    ledger = spark.createDataFrame([("p", f"t{k}", k) for k in range(20)] + [("p", "open", None), ("q", "t0", 0)], "partition string, token string, part long")
    batch = spark.createDataFrame([("p", "t0"), ("p", "t3"), ("p", "t4"), ("p", "open"), ("p", "new"), ("q", "t0"), ("q", "t4")], "partition string, token string")
    assert sorted(tuple(r) for r in ev.unseen(batch, ledger).collect()) == [("p", "new"), ("p", "t0"), ("p", "t3"), ("q", "t4")]


def test_content_tokens(spark):
    """Order, time, keys, payloads, token and operator all tell batches apart; equal batches have one name."""
    base = [(1, 0, 5, "p", "x", b"ab"), (1, 1, 6, "p", "y", b"c")]
    other = {
        2: [(2, 0, 5, "p", "x", b"ab"), (2, 1, 6, "p", "y", b"c")],  # the same
        3: [(3, 1, 5, "p", "x", b"ab"), (3, 0, 6, "p", "y", b"c")],  # turned round
        4: [(4, 0, 5, "p", "x", b"a"), (4, 1, 6, "p", "y", b"bc")],
        5: [(5, 0, 7, "p", "x", b"ab"), (5, 1, 6, "p", "y", b"c")],
        6: [(6, 0, 5, "px", "", b"ab"), (6, 1, 6, "p", "y", b"c")],
        7: [(7, 0, 5, "p", "x", b"ab")],
    }
    rows = [*base, *(r for some in other.values() for r in some)]
    df = spark.createDataFrame(rows, "batch long, n long, t long, producer string, trace string, raw binary").withColumn("operator", F.lit(9)).withColumn("token", F.lit("tok"))
    got = {r["batch"]: r["content_token"] for r in ev.batch_tokens(TABLE, df, "operator", "token", "n", ["batch"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 6 and len(got[1]) == 64


def test_an_empty_key_is_no_absent_one(spark, tmp_path):
    rows = [(1, "", "a", b"x"), (2, "p", "a", b"y"), (3, "", "b", b"z")]
    path = f"file://{tmp_path}/t"
    ev.write(TABLE, spark.createDataFrame(rows, "t long, producer string, trace string, raw binary"), path)
    found = ev.read(spark, TABLE, path)
    assert ev.misplaced(TABLE, found).isEmpty()
    assert sorted(r["t"] for r in ev.select(TABLE, found, ev.EventQuery(equals={"producer": ""}, columns=("t",))).collect()) == [1, 3]


def test_costs(spark, tmp_path):
    """What a query reads: few bytes beside the payloads, nothing out of the window."""
    rows = spark.range(2_048).select(F.col("id").alias("t"), F.lit("p").alias("producer"), F.concat(F.lit("trace-"), F.col("id") % 4).alias("trace"), F.expr("cast(repeat('x', 2048) as binary)").alias("raw"))
    table, path = ev.EventTable("t", ("producer", "trace"), 512, "producer", ("trace",)), f"file://{tmp_path}/t"
    ev.write(table, rows, path)
    stored_rows = ev.read(spark, table, path)
    stats = lambda q: ev.statistics(table, stored_rows, q).first().asDict()
    raw, projected = stats(ev.EventQuery(columns=("raw",))), stats(ev.EventQuery(columns=("t", "trace")))
    assert projected["bytes"] * 10 < raw["bytes"] and raw["rows"] == raw["candidates"] == 2_048
    assert stats(ev.EventQuery(10_000)) == {"partitions": 0, "candidates": 0, "rows": 0, "bytes": 0}
    assert stats(ev.EventQuery(600, 700, {"trace": "trace-1"})) == {"partitions": 1, "candidates": 512, "rows": 25, "bytes": 25 * (8 + 1 + 7 + 2_048)}


# ---- joins against a nested loop --------------------------------------------

@pytest.mark.parametrize("kind", ["bool", "int", "uint", "text", "bytes"])
@pytest.mark.parametrize("mode", ["inner", "left"])
def test_join_is_the_nested_loop(spark, kind, mode):
    a, c = {"bool": (True, False), "int": (-(2**63), 2**63 - 1), "uint": (2**64 - 1, 0), "text": ("é", ""), "bytes": (b"\x00\xff", b"")}[kind]
    table = ev.EventTable("t", ("side",), 1_000, None, (), (("lk", kind), ("rk", kind), ("value", "text")))
    lefts = [(1, a), (1, a), (2, a), (3, None), (4, c)]
    rights = [(10, a), (10, a), (11, None), (12, c)]
    rows = [(t, "l", b"", k, None, f"l{n}") for n, (t, k) in enumerate(lefts)] + [(t, "r", b"", None, k, None if n == 1 else f"r{n}") for n, (t, k) in enumerate(rights)]
    types = {"bool": "boolean", "int": "long", "uint": "string", "text": "string", "bytes": "binary"}[kind]
    if kind == "uint":
        rows = [(*r[:3], None if r[3] is None else str(r[3]), None if r[4] is None else str(r[4]), r[5]) for r in rows]
    df = spark.createDataFrame(rows, f"t long, side string, raw binary, lk {types}, rk {types}, value string")
    stored = ev.as_stored(table, df)
    left = Side("lk", ev.EventQuery(equals={"side": "l"}), columns=("t", "value"))
    right = Side("rk", ev.EventQuery(equals={"side": "r"}), columns=("t", "value"))
    got = sorted(((r["left"]["t"], r["left"]["value"], None if r["right"] is None else r["right"]["t"], r["present"]) for r in join(table, stored, left, right, mode).collect()), key=str)
    want = []
    for n, (t, k) in enumerate(lefts):
        hits = [x for x, y in rights if k is not None and y == k]
        want += [(t, f"l{n}", x, True) for x in hits] or ([(t, f"l{n}", None, False)] if mode == "left" else [])
    assert got == sorted(want, key=str)


def test_join_conditions_and_budgets(spark, stored):
    rows = ev.read(spark, TABLE, stored)
    left = Side("trace", ev.EventQuery(0, 8), equals={"ok": True}, columns=("t",))
    right = Side("trace", ev.EventQuery(8, 16), missing=("ok",), columns=("t",))
    got = sorted((r["left"]["t"], r["right"]["t"]) for r in join(TABLE, rows, left, right, "inner").collect())
    ls = [r for r in RECORDS if r[0] < 8 and r[4] is True]
    rs = [r for r in RECORDS if 8 <= r[0] < 16 and r[4] is None]
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(ls, rs) if x[2] == y[2])
    for bad in (Side("code"), Side("trace", equals={"ok": None})):
        with pytest.raises(ev.EventError):
            join(TABLE, rows, left, bad)
    for budget in (JoinBudget(build_rows=1), JoinBudget(rows=0)):
        with pytest.raises(ev.EventError):
            join(TABLE, rows, left, right, "inner", budget)


def test_batches(spark, stored):
    found = ev.select(TABLE, ev.read(spark, TABLE, stored), ev.EventQuery(columns=("t",)))
    sizes = [len(b) for b in ev.batches(found, 15)]
    assert sum(sizes) == 40 and sizes == [15, 15, 10]
    for bad in (0, 65_537):
        with pytest.raises(ev.EventError):
            next(ev.batches(found, bad))
