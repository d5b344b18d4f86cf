import pytest

from millrace.functions.literals import LiteralError, parse, seconds
from millrace.operators.query import QueryError, form, run, selected
from millrace.sources.schema import SchemaError
from worlds import ids, school


@pytest.fixture(scope="module")
def w(spark):
    return school(spark)


def found(w, f):
    return sorted(ids(selected(w, f)))


def test_liveness_and_history(w):
    assert found(w, form("Student")) == [1, 2, 3, 4]
    assert sorted(ids(w.history("Student"))) == [1, 2, 3, 4, 5]
    assert ids(w.point("student", 5)) == [] and ids(w.trace("Student", 5)) == [5]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (form("Student").when("points", "=", "+07"), [1, 4]),
        (form("Student").when("points", "!=", 7), [2]),
        (form("Student").when("points", "<", "7"), [2]),
        (form("Student").when("name", ">", "Z"), [2, 4]),
        (form("Student").when("passed", ">=", "false"), []),
        (form("Student").when("passed", "=", "true"), [1]),
        (form("Student").any("points", ["7", "-3"]), [1, 2, 4]),
        (form("Student").any("points", []), []),
        (form("Student").when("name", "like", "AN"), [1]),
        (form("Course").when("title", "like", "0%"), [1]),
        (form("Course").when("title", "like", "_"), []),
        (form("Student").missing("name"), [3]),
        (form("Student").missing("id"), []),
        (form("Student").has("COURSES", 1), [1]),
        (form("Student").has("courses", 3), []),
        (form("Student").some("courses", "grade", "=", "A"), [1]),
        (form("Student").some("courses", "title", "like", "phys"), [2, 4]),
        (form("Student").some("courses", "id", "<", "2"), [1]),
        (form("Student").some("courses", "grade", "missing"), []),
        (form("Student").some("courses", "id", "like", "1"), []),
        (form("Student").when("points", "=", "7").when("name", "=", "Ann"), [1]),
    ],
)
def test_predicates(w, f, want):
    assert found(w, f) == want


def test_errors_come_before_anything_runs(w):
    for bad in (form("Student").when("points", ">", "abc"), form("Student").when("points", "=", " 7"), form("Student").when("passed", "=", "yes")):
        with pytest.raises(LiteralError):
            selected(w, bad)
    with pytest.raises(QueryError):
        selected(w, form("Student").when("points", "like", "7"))
    with pytest.raises(SchemaError):
        selected(w, form("Student").when("Points", "=", "7"))
    with pytest.raises(SchemaError):
        selected(w, form("Nobody"))


def test_literals():
    assert parse("int", "-9223372036854775808") == -(2**63)
    for bad in ("9223372036854775808", "", "1.0", "0x1", "+"):
        with pytest.raises(LiteralError):
            parse("int", bad)
    assert seconds("3h") == 10_800 and seconds("forever") is None


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (form("Student").order("points"), [2, 1, 4, 3]),
        (form("Student").order("points", True), [3, 1, 4, 2]),
        (form("Student").order("name"), [3, 1, 4, 2]),
        (form("Student").order("passed"), [2, 1, 3, 4]),
        (form("Student").order("points", True).top(2), [3, 1]),
        (form("Student").top(0), []),
        (form("Student").order("points", True).past(1), [4, 2]),
        (form("Student").order("points").past(3), []),
        (form("Student").order("points").past(99), []),
        (form("Student").past(2).top(1), [3]),
    ],
)
def test_order_and_pages(w, f, want):
    assert ids(run(w, f).rows) == want


def test_count_ignores_the_page(w):
    assert run(w, form("Student").order("points").top(1).past(2).count()).count.first()["count"] == 4


def test_links(w):
    pack = run(w, form("Student").order("id").top(2).link("courses"))
    assert ids(pack.links["Student.courses"]) == [10, 12]
    assert ids(pack.one()) == [1]
    with pytest.raises(QueryError):
        run(w, form("Student").link("courses"), cap=1)
    assert run(w, form("Student").order("id", True).link("courses")).horizon().first()[0] == 2_000


def test_count_reads_no_data_columns(spark, tmp_path):
    from millrace.operators.world import World

    w = school(spark)
    w.tables["Student"].write.parquet(f"{tmp_path}/s")
    stored = World(w.schema, {**w.tables, "Student": spark.read.parquet(f"{tmp_path}/s")}, w.edges, w.now)
    plan = run(stored, form("Student").when("points", "=", "7").count()).count._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(points,7)" in plan and "name" not in plan.split("ReadSchema")[1]


def test_shapes_and_digests(w):
    a = form("Student").when("points", "=", "7").some("courses", "grade", "=", "A").link("courses").order("name", True).top(3)
    b = form("Student").when("points", "=", "8").some("courses", "grade", "=", "B").link("courses").order("name", True).top(9)
    assert a.shape() == b.shape() == "from Student; points =; courses some (grade =); link courses; name desc; limit"
    assert a.digest() != b.digest() and a.digest() == form("Student").when("points", "=", "7").some("courses", "grade", "=", "A").link("courses").order("name", True).top(3).digest()
    assert run(w, form("Course").top(1)).json()["Course"].first()["json"] == '{"id":1,"code":"m","title":"Maths 100%"}'
