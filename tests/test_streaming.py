import pytest

from millrace.operators.policy import Grant, Principal
from millrace.streaming import changes
from worlds import forge


def entries(spark, rows):
    return spark.createDataFrame(rows, changes.LOG)


def test_append_window_and_cursor(spark):
    log = entries(spark, [(1, "put", "Repo", 1, "a")])
    fresh = spark.createDataFrame([("set", "Repo", 1), ("put", "Issue", 1)], "verb string, unit string, key long")
    log = changes.appended(log, fresh, "b", 1)
    assert sorted((r["id"], r["unit"], r["who"]) for r in log.collect()) == [(1, "Repo", "a"), (2, "Issue", "b"), (3, "Repo", "b")]
    assert [r["id"] for r in changes.after(log, 1).collect()] == [2, 3]
    assert [r["id"] for r in changes.kept(log, 2).orderBy("id").collect()] == [2, 3]
    with pytest.raises(changes.CursorError):
        changes.after(log, 0, window=2)


def test_visible_feed(spark):
    w = forge(spark)
    log = entries(spark, [(1, "put", "Repo", 1, "x"), (2, "put", "Repo", 3, "x"), (3, "end", "Repo", 77, "x"), (4, "tie", "Team.members", 1, "x"), (5, "cut", "Team.members", 9, "x"), (6, "put", "Issue", 2, "x")])
    see = lambda grants: sorted(r["id"] for r in changes.heard(w, log, grants, Principal(1)).collect())
    assert see([]) == []
    assert see([Grant("1", "see", "Actor", row=1)]) == [1, 6]
    assert see([Grant("1", "see", "Repo")]) == [1, 2, 3]
    assert see([Grant("1", "see", "Team", row=1)]) == [4]
    assert see([Grant("1", "see", "*")]) == [1, 2, 3, 4, 5, 6]
    assert changes.heard(w, log, [], Principal(sudo=True)).count() == 6


def test_tail_delivers_filtered_batches_once(spark, tmp_path):
    path, got = f"file://{tmp_path}/log", []
    entries(spark, [(1, "put", "Repo", 1, "a"), (2, "put", "Issue", 1, "a")]).write.parquet(path)

    def start():
        q = changes.deliver(changes.tail(spark, path), lambda df, n: got.extend((r["id"], n) for r in df.collect()), f"file://{tmp_path}/ck", units=["Repo"], verbs=["put", "end"])
        q.awaitTermination(60)

    start()
    entries(spark, [(3, "end", "Repo", 1, "a"), (4, "set", "Repo", 1, "a")]).write.mode("append").parquet(path)
    start()
    start()
    assert got == [(1, 0), (3, 1)]


def test_append_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "k string, v long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).write.parquet(source)

    def start():
        stream = spark.readStream.schema(schema).parquet(source)
        changes.append_once(stream, out, f"file://{tmp_path}/ledger", f"file://{tmp_path}/ck", ["k", "v"]).awaitTermination(60)

    start()
    spark.createDataFrame([("b", 2), ("c", None)], schema).write.mode("append").parquet(source)
    start()
    assert sorted(((r["k"], r["v"]) for r in spark.read.parquet(out).collect()), key=str) == [("a", 1), ("b", 2), ("c", None)]


def test_outbox_acknowledgements(spark):
    schema = "entity string, field string, key long"
    box = spark.createDataFrame([("A", None, 1), ("A", "f", 1), ("B", None, 2)], schema)
    left = changes.acknowledged(box, spark.createDataFrame([("A", None, 1)], schema))
    assert sorted((r["entity"], r["field"]) for r in left.collect()) == [("A", "f"), ("B", None)]
