"""The registered queries: each with its Spark form and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import convert, filled, is_int_text, partition_id
from ..functions.literals import LiteralError, seconds
from ..functions.session import fresh_path
from ..operators import evolve, graph, mutate
from ..operators.eventjoin import JoinBudget, Side, join
from ..operators.policy import ME, Grant, Principal, change_allowed, may_grant, memberships, minted, run_as
from ..operators.query import QueryError, Test, form, ranked, run, selected, sort_keys
from ..operators.world import World
from ..sources import documents as docs
from ..sources import events as ev
from ..sources.schema import Entity, Field, Reference, Relation, Schema, SchemaError
from ..streaming import changes
from . import bindings as b
from .bindings import DAY, EVENTS, NOW, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, recursive)
        return f

    return keep


ORDER = "id, status, priority, total_cents"
_ORDER = ORDER.split(", ")


# ---- scans and predicates ---------------------------------------------------

@query(f"SELECT {ORDER} FROM live_orders")
def live_scan(spark, sf):
    """S1"""
    return b.world(spark, sf).rows("Orders").select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE id = 77")
def point_lookup(spark, sf):
    """S2"""
    return b.world(spark, sf).point("Orders", 77).select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE status = 'O' AND customer_id = 7")
def eq_pushdown(spark, sf):
    """S3, P1"""
    return b.world(spark, sf).equal("Orders", {"status": "O", "customer_id": 7}).select(*_ORDER)


@query(f"SELECT {ORDER} FROM e_orders WHERE id IN (3, 4, 5)")
def history_trace(spark, sf):
    """Dead rows too"""
    return b.world(spark, sf).history("Orders").filter(F.col("id").isin(3, 4, 5)).select(*_ORDER)


@query("SELECT id, l, r, qty FROM edges WHERE l = 5")
def edge_scan(spark, sf):
    """S6"""
    return b.world(spark, sf).edges_of("Orders", "parts", 5).select("id", F.col("left").alias("l"), F.col("right").alias("r"), "qty")


def _ids(spark, sf, f) -> DataFrame:
    return selected(b.world(spark, sf), f).select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE note <> '5-LOW'")
def ne_skips_null(spark, sf):
    """P2"""
    return _ids(spark, sf, form("Orders").when("note", "!=", "5-LOW"))


@query(f"SELECT {ORDER} FROM live_orders WHERE total_cents >= 45000000")
def range_int(spark, sf):
    """P3"""
    return _ids(spark, sf, form("Orders").when("total_cents", ">=", "+045000000"))


@query(f"SELECT {ORDER} FROM live_orders WHERE priority < '2'")
def range_text(spark, sf):
    """P3"""
    return _ids(spark, sf, form("orders").when("priority", "<", "2"))


@query(f"SELECT {ORDER} FROM live_orders WHERE false")
def range_bool_false(spark, sf):
    """Booleans have no order"""
    return _ids(spark, sf, form("Orders").when("urgent", ">=", "false"))


@query(f"SELECT {ORDER} FROM live_orders WHERE status IN ('F', 'P') AND total_cents IN (11294626, 47327417)")
def in_list(spark, sf):
    """P4"""
    return _ids(spark, sf, form("Orders").any("status", ["F", "P"]).any("total_cents", ["11294626", "047327417"]))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red')")
def contains_fold(spark, sf):
    """P5, F1"""
    return selected(b.world(spark, sf), form("Part").when("name", "like", "RED")).select("id", "name")


@query(f"SELECT {ORDER} FROM live_orders WHERE note IS NULL")
def is_null_ref(spark, sf):
    """P6"""
    return _ids(spark, sf, form("Orders").missing("note"))


@query(f"SELECT {ORDER} FROM live_orders o WHERE EXISTS (SELECT 1 FROM held_edges e WHERE e.l = o.id AND e.r = 7)")
def has_edge(spark, sf):
    """P7, J9, J12"""
    return _ids(spark, sf, form("Orders").has("parts", 7))


@query(f"SELECT {ORDER} FROM live_orders o WHERE EXISTS (SELECT 1 FROM held_edges e WHERE e.l = o.id AND e.returnflag = 'R')")
def some_edge_field(spark, sf):
    """P8"""
    return _ids(spark, sf, form("Orders").some("parts", "returnflag", "=", "R"))


@query(f"SELECT {ORDER} FROM live_orders o WHERE EXISTS (SELECT 1 FROM held_edges e JOIN part ON p_partkey = e.r WHERE e.l = o.id AND contains(lower(p_name), 'red'))")
def some_target_field(spark, sf):
    """P8"""
    return _ids(spark, sf, form("Orders").some("parts", "name", "like", "Red"))


@query(f"SELECT {ORDER} FROM live_orders o WHERE EXISTS (SELECT 1 FROM held_edges e WHERE e.l = o.id AND e.r < 20)")
def some_target_id(spark, sf):
    """P8"""
    return _ids(spark, sf, form("Orders").some("parts", "id", "<", "20"))


@query(f"SELECT {ORDER} FROM live_orders WHERE false")
def some_missing_edge_field(spark, sf):
    """Absence of an edge's field never matches"""
    return _ids(spark, sf, form("Orders").some("parts", "qty", "missing"))


@query(f"SELECT {ORDER} FROM live_orders WHERE status = 'O' AND total_cents > 20000000 AND priority <> '5-LOW'")
def conjunction(spark, sf):
    """P10"""
    return _ids(spark, sf, form("Orders").when("status", "=", "O").when("total_cents", ">", "20000000").when("priority", "!=", "5-LOW"))


@query("SELECT count(*) AS count FROM live_orders WHERE status = 'O'")
def count_filtered(spark, sf):
    """A1"""
    return run(b.world(spark, sf), form("Orders").when("status", "=", "O").order("total_cents").top(3).count()).count


# ---- order and pages --------------------------------------------------------

def _ranked(spark, sf, f) -> DataFrame:
    w = b.world(spark, sf)
    return ranked(selected(w, f), sort_keys(w.schema.entity("Orders"), f.sorts)).select("id", "rank")


_RANKS = "SELECT id, row_number() OVER (ORDER BY {}) AS rank FROM {}"


@query(_RANKS.format("expires_at DESC NULLS FIRST, id", "live_orders"))
def order_nulls_int(spark, sf):
    """Absent integers come first in descending order"""
    return _ranked(spark, sf, form("Orders").order("expires_at", descending=True))


@query(_RANKS.format("expires_at ASC NULLS LAST, id", "live_orders"))
def order_nulls_int_up(spark, sf):
    """T1"""
    return _ranked(spark, sf, form("Orders").order("expires_at"))


@query(_RANKS.format("coalesce(note, '') DESC, total_cents, id", "live_orders"))
def order_null_text(spark, sf):
    """Absent text sorts as the empty text, last in descending order"""
    return _ranked(spark, sf, form("Orders").order("note", descending=True).order("total_cents"))


@query("""SELECT test, n FROM (SELECT 'urgent = true' AS test, count(*) AS n FROM live_orders WHERE urgent UNION ALL SELECT 'urgent != true', count(*) FROM live_orders WHERE NOT urgent
UNION ALL SELECT 'urgent >= false', 0 UNION ALL SELECT 'urgent < true', 0 UNION ALL SELECT 'parts qty missing', 0
UNION ALL SELECT 'parts qty > 0', count(*) FROM live_orders o WHERE EXISTS (SELECT 1 FROM held_edges e WHERE e.l = o.id)
UNION ALL SELECT 'past an unknown row', 0 UNION ALL SELECT 'past the first row', count(*) - 1 FROM live_orders)""")
def never_matches(spark, sf):
    """Tests that match nothing beside ones that do"""
    w, f = b.world(spark, sf), form("Orders")
    first = run(w, f.order("total_cents").top(1)).rows.first()["id"]
    cases = {
        "urgent = true": f.when("urgent", "=", "true"),
        "urgent != true": f.when("urgent", "!=", "true"),
        "urgent >= false": f.when("urgent", ">=", "false"),
        "urgent < true": f.when("urgent", "<", "true"),
        "parts qty missing": f.some("parts", "qty", "missing"),
        "parts qty > 0": f.some("parts", "qty", ">", "0"),
        "past an unknown row": f.order("total_cents").past(-5),
        "past the first row": f.order("total_cents").past(first),
    }
    counts = [run(w, q).rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("test"), "n") for name, q in cases.items()]
    return reduce(DataFrame.union, counts)


@query(f"SELECT {ORDER} FROM live_orders WHERE status = 'F' AND priority = '1-URGENT' ORDER BY total_cents DESC, id LIMIT 10")
def top_k(spark, sf):
    """T2"""
    f = form("Orders").when("status", "=", "F").when("priority", "=", "1-URGENT").order("total_cents", descending=True).top(10)
    return run(b.world(spark, sf), f).rows.select(*_ORDER)


@query(f"""+ seq AS (SELECT *, row_number() OVER (ORDER BY total_cents DESC, id) AS n FROM live_orders WHERE status = 'O')
SELECT {ORDER} FROM seq WHERE n > (SELECT n FROM seq WHERE total_cents = (SELECT max(total_cents) FROM seq WHERE n > 40) LIMIT 1) ORDER BY n LIMIT 25""")
def cursor_page(spark, sf):
    """T3"""
    w = b.world(spark, sf)
    f = form("Orders").when("status", "=", "O").order("total_cents", descending=True)
    cursor = run(w, f.top(41)).rows.agg(F.max_by("id", F.struct(-F.col("total_cents"), "id"))).first()[0]
    return run(w, f.past(cursor).top(25)).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE false")
def cursor_missing(spark, sf):
    """An unknown cursor gives nothing"""
    return run(b.world(spark, sf), form("Orders").order("total_cents").past(-5)).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE priority = '3-MEDIUM' ORDER BY total_cents, id LIMIT 1")
def first_row(spark, sf):
    """T6"""
    return run(b.world(spark, sf), form("Orders").when("priority", "=", "3-MEDIUM").order("total_cents")).one().select(*_ORDER)


@query("""+ page AS (SELECT id FROM live_orders ORDER BY total_cents DESC, id LIMIT 20)
SELECT id, l, r, qty, returnflag FROM held_edges WHERE l IN (SELECT id FROM page)""")
def link_bag(spark, sf):
    """J4, J12, B4"""
    pack = run(b.world(spark, sf), form("Orders").order("total_cents", descending=True).top(20).link("parts"))
    return pack.links["Orders.parts"].select("id", F.col("left").alias("l"), F.col("right").alias("r"), "qty", "returnflag")


@query("SELECT min(expires_at) AS horizon FROM (SELECT * FROM live_orders ORDER BY total_cents DESC, id LIMIT 500)")
def change_horizon(spark, sf):
    """A10"""
    return run(b.world(spark, sf), form("Orders").order("total_cents", descending=True).top(500)).horizon()


# ---- event tables -----------------------------------------------------------

_FROM, _TO = 1_704_844_800_000_000, 1_705_276_800_000_000


def _stored_events(spark, sf):
    return ev.as_stored(EVENTS, b.events(spark, sf))


@query(f"SELECT raw FROM e_events WHERE moment >= {_FROM} AND moment < {_TO}")
def event_window(spark, sf):
    """S7, S8, P11"""
    return ev.payloads(EVENTS, _stored_events(spark, sf), ev.EventQuery(_FROM, _TO)).select(F.hex("raw").alias("raw"))


@query(f"SELECT value_cents, usr, moment FROM e_events WHERE moment >= {_FROM} AND moment < {_TO} AND event_type = 'click' AND usr = '46'")
def event_key_project(spark, sf):
    """S9, S10, P12, J1"""
    q = ev.EventQuery(_FROM, _TO, {"event_type": "click", "user": "46"}, ("value_cents", "user", "moment"))
    return ev.select(EVENTS, _stored_events(spark, sf), q).withColumnRenamed("user", "usr")


@query(f"SELECT count(*) AS count FROM e_events WHERE moment >= {_FROM} AND moment < {_TO} AND event_type = 'view'")
def event_count(spark, sf):
    """A3"""
    return ev.count(EVENTS, _stored_events(spark, sf), ev.EventQuery(_FROM, _TO, {"event_type": "view"}))


@query(f"SELECT count(*) AS count FROM e_events WHERE moment >= {9 * _TO}")
def event_out_of_window(spark, sf):
    """Nothing lies in the window"""
    return ev.count(EVENTS, _stored_events(spark, sf), ev.EventQuery(9 * _TO))


@query("SELECT moment, usr, value_cents FROM e_events WHERE event_type = 'error' AND usr = '8'")
def event_of_source(spark, sf):
    """S11"""
    q = ev.EventQuery(equals={"event_type": "error"}, columns=("moment", "user", "value_cents"))
    return ev.of_source(EVENTS, _stored_events(spark, sf), q, "user", "8", allowed=True).withColumnRenamed("user", "usr")


@query(f"""SELECT concat('k', lower(hex(encode(event_type))), '-', CAST(moment // {DAY} AS VARCHAR)) AS partition, min(moment) AS since, max(moment) + 1 AS until, count(*) AS rows
FROM e_events GROUP BY 1""")
def event_partition_summary(spark, sf):
    """A8, F7"""
    return ev.summary(EVENTS, b.events(spark, sf))


@query(f"SELECT moment, usr, event_type FROM e_events WHERE moment // {DAY} >= 19740")
def retain_floor(spark, sf):
    """W5"""
    return ev.retained(_stored_events(spark, sf), EVENTS, 19_740).select("moment", F.col("user").alias("usr"), "event_type")


@query("SELECT count(*) AS rows, sum(8 + octet_length(encode(usr)) + octet_length(unhex(raw)) + 8 + CASE WHEN flag IS NULL THEN 0 ELSE 1 END) AS bytes FROM e_events WHERE event_type = 'view'")
def event_sizes(spark, sf):
    """Charged sizes of a query's columns"""
    found = ev.select(EVENTS, _stored_events(spark, sf), ev.EventQuery(equals={"event_type": "view"}, columns=("moment", "user", "raw", "value_cents", "flag")))
    size = sum((ev.value_bytes(F.col(c), EVENTS.kind(c)) for c in found.columns), F.lit(0))
    return found.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


@query("SELECT moment, usr, CAST(NULL AS VARCHAR) AS added FROM e_events WHERE event_type = 'signup'")
def event_evolved(spark, sf):
    """Older parts read a new field as null"""
    wide = EVENTS.evolved((*EVENTS.fields, ("added", "text")))
    rows = ev.as_stored(wide, b.events(spark, sf))
    return ev.select(wide, rows, ev.EventQuery(equals={"event_type": "signup"}, columns=("moment", "user", "added"))).withColumnRenamed("user", "usr")


@query("""+ ledger AS (SELECT concat('p', CAST(event_id // 2 % 3 AS VARCHAR)) AS p, CAST(event_id // 2 % 4000 AS VARCHAR) AS token, CASE WHEN event_id % 40 = 39 THEN NULL ELSE event_id % 40 END AS part FROM events WHERE event_id % 2 = 0),
late AS (SELECT p, part FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY part DESC) AS n FROM (SELECT DISTINCT p, part FROM ledger WHERE part IS NOT NULL)) WHERE n <= 16),
seen AS (SELECT p, token FROM ledger WHERE part IS NULL UNION SELECT l.p, l.token FROM ledger l JOIN late USING (p, part))
SELECT event_id FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.p = concat('p', CAST(e.event_id // 2 % 3 AS VARCHAR)) AND s.token = CAST(e.event_id // 2 % 4000 AS VARCHAR))""")
def token_dedup(spark, sf):
    """G5"""
    e = b.table(spark, sf, "events").select("event_id", F.expr("concat('p', event_id div 2 % 3)").alias("partition"), F.expr("string(event_id div 2 % 4000)").alias("token"))
    ledger = e.filter("event_id % 2 = 0").select("partition", "token", F.when(F.col("event_id") % 40 != 39, F.col("event_id") % 40).alias("part"))
    return ev.unseen(e.filter("event_id % 2 = 1"), ledger).select("event_id")


# ---- joins ------------------------------------------------------------------

def _join(spark, sf, mode, right_equals, left_missing=()):
    left = Side("user", ev.EventQuery(_FROM, _TO, {"event_type": "purchase"}), missing=left_missing, columns=("moment", "value_cents"))
    right = Side("user", ev.EventQuery(_FROM, _TO, {"event_type": "signup"}), equals=right_equals, columns=("moment", "value_cents"))
    out = join(EVENTS, _stored_events(spark, sf), left, right, mode)
    return out.select(F.col("left.moment").alias("l_at"), F.col("left.value_cents").alias("l_cents"), F.col("right.moment").alias("r_at"), F.col("right.value_cents").alias("r_cents"), "present")


def _join_sql(mode, right, left=""):
    return f"""+ lhs AS (SELECT * FROM e_events WHERE event_type = 'purchase' AND moment >= {_FROM} AND moment < {_TO}{left}),
rhs AS (SELECT *, true AS m FROM e_events WHERE event_type = 'signup' AND moment >= {_FROM} AND moment < {_TO}{right})
SELECT l.moment AS l_at, l.value_cents AS l_cents, r.moment AS r_at, r.value_cents AS r_cents, coalesce(r.m, false) AS present FROM lhs l {mode} JOIN rhs r ON l.usr = r.usr"""


@query(_join_sql("INNER", ""))
def join_inner(spark, sf):
    """J5, J7, J8"""
    return _join(spark, sf, "inner", {})


@query(_join_sql("LEFT", " AND flag = true"))
def join_left_present(spark, sf):
    """J6, J7, P13"""
    return _join(spark, sf, "left", {"flag": True})


@query(_join_sql("LEFT", "", " AND flag IS NULL"))
def join_missing_condition(spark, sf):
    """P13"""
    return _join(spark, sf, "left", {}, ("flag",))


@query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM edges WHERE r = p_partkey AND qty = 50)")
def anti_unreferenced(spark, sf):
    """J10"""
    w = b.world(spark, sf)
    held = w.relation("Orders", "parts").filter("qty = 50").select(F.col("right").alias("id"))
    return w.rows("Part").join(held, "id", "left_anti").select("id")


@query(f"""+ e2 AS (SELECT *, CASE WHEN id % 2 = 0 THEN {NOW} - 10 END AS ends FROM e_orders)
SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM e2 WHERE customer_id = c_custkey AND (ends IS NULL OR ends > {NOW}))""")
def collect_rows(spark, sf):
    """Ended rows that nothing live points to"""
    w = b.world(spark, sf)
    ended = F.when(F.col("id") % 7 == 0, F.lit(NOW - 100)).cast("long")
    orders_end = F.when(F.col("id") % 2 == 0, F.lit(NOW - 10)).cast("long")
    tables = {**w.tables, "Customer": w.tables["Customer"].withColumn("expires_at", ended), "Orders": w.tables["Orders"].withColumn("expires_at", orders_end)}
    w = type(w)(w.schema, tables, w.edges, NOW)
    return graph.collectable_rows(w, "Customer", NOW - 50)


@query(f"""+ gone AS (SELECT id FROM e_orders WHERE expires_at <= {NOW - 86400 * 30}) SELECT e.id FROM edges e JOIN gone g ON g.id = e.l""")
def collect_edges(spark, sf):
    """G13"""
    return graph.collectable_edges(b.world(spark, sf), "Orders", "parts", NOW - 86_400 * 30)


# ---- graphs -----------------------------------------------------------------

_CLOSURE = "+ reach(root, reach) AS (SELECT l, r FROM children WHERE l <> r UNION SELECT p.root, c.r FROM reach p JOIN children c ON p.reach = c.l WHERE p.root <> c.r)"


@query(f"{_CLOSURE} SELECT root, reach FROM reach", recursive=True)
def closure_pairs(spark, sf):
    """G7"""
    return graph.closure(b.world(spark, sf).relation("Part", "children"))


@query(f"""{_CLOSURE}, asked AS (SELECT p_partkey AS l, p_partkey // 100 AS r FROM part)
SELECT DISTINCT l, r FROM asked a WHERE l = r OR EXISTS (SELECT 1 FROM reach WHERE root = a.r AND reach = a.l)""", recursive=True)
def closure_cycle_probe(spark, sf):
    """G8"""
    w = b.world(spark, sf)
    asked = w.rows("Part").select(F.col("id").alias("left"), F.expr("id div 100").alias("right"))
    return graph.closes_cycle(graph.closure(w.relation("Part", "children")), asked).select(F.col("left").alias("l"), F.col("right").alias("r")).distinct()


_FALL = """+ f0 AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey = 1), f1 AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT k FROM f0)),
f2 AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM f1)), f2s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM f1)),
f3 AS (SELECT id AS k FROM live_orders WHERE customer_id IN (SELECT k FROM f2)),
fall AS (SELECT 'Region' AS entity, 0 AS layer, CAST(k AS BIGINT) AS key FROM f0 UNION ALL SELECT 'Nation', 1, k FROM f1 UNION ALL SELECT 'Customer', 2, k FROM f2
UNION ALL SELECT 'Supplier', 2, k FROM f2s UNION ALL SELECT 'Orders', 3, k FROM f3)"""


def _fall(spark, sf):
    w = b.world(spark, sf)
    return w, graph.frontier(w, "Region", w.point("Region", 1).select("id"))


@query(f"{_FALL} SELECT entity, CAST(layer AS BIGINT) AS layer, key FROM fall")
def cascade_frontier(spark, sf):
    """G9"""
    return _fall(spark, sf)[1].withColumn("layer", F.col("layer").cast("long"))


@query(f"{_FALL} SELECT entity, count(DISTINCT key) AS keys FROM fall GROUP BY entity")
def cascade_counts(spark, sf):
    """A4"""
    return graph.frontier_counts(_fall(spark, sf)[1])


@query("""SELECT 'Orders' AS holder, 'parts' AS name, e.id AS key, e.r AS target FROM edges e JOIN live_orders o ON o.id = e.l WHERE e.r = 7
UNION ALL SELECT 'Part', 'children', r, r FROM children WHERE r = 7 AND l <> 7 UNION ALL SELECT 'Part', 'children', r, r FROM children WHERE false""")
def cascade_blocked_holders(spark, sf):
    """G10"""
    w = b.world(spark, sf)
    reached = graph.frontier(w, "Part", w.point("Part", 7).select("id"))
    return graph.blocking_holders(w, reached)


@query(f"{_FALL} SELECT id, CAST({NOW} AS BIGINT) AS expires_at FROM live_orders WHERE id IN (SELECT k FROM f3)")
def cascade_retired(spark, sf):
    """The orders that end"""
    w, reached = _fall(spark, sf)
    after = graph.retired(w, reached, "Orders", NOW, NOW)
    return after.filter((F.col("expires_at") == NOW) & (F.col("updated_at") == NOW)).select("id", "expires_at")


@query("""SELECT o.id, 0 AS hop, 'Orders' AS entity, o.id AS key FROM live_orders o UNION ALL SELECT o.id, 1, 'Customer', customer_id FROM live_orders o
UNION ALL SELECT o.id, 2, 'Nation', c.nation_id FROM live_orders o JOIN e_customer c ON c.id = customer_id
UNION ALL SELECT o.id, 3, 'Region', n_regionkey FROM live_orders o JOIN e_customer c ON c.id = customer_id JOIN nation ON n_nationkey = c.nation_id""")
def owner_chain(spark, sf):
    """J11"""
    return graph.owner_chain(b.world(spark, sf), "Orders")


@query("SELECT p_brand AS brand, p_name AS name, count(*) AS rows FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf):
    """A5, G11"""
    return graph.duplicates(b.world(spark, sf).rows("Part"), "name", ["brand"])


@query("SELECT customer_id AS target, count(*) AS rows FROM live_orders WHERE expires_at IS NULL GROUP BY 1 HAVING count(*) > 1")
def one2one_violations(spark, sf):
    """G12"""
    return graph.shared_targets(b.world(spark, sf).rows("Orders"), "customer_id")


@query("SELECT id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY id) AS serial FROM e_orders")
def serial_per_scope(spark, sf):
    """A7, section 2.5: counters within a scope, continued from what is there"""
    w = b.world(spark, sf)
    own = w.schema.entity("Orders")
    own = replace(own, fields=(*own.fields, Field("serial", "int", serial=("customer_id",))))
    rows = w.history("Orders").withColumn("serial", F.lit(None).cast("long"))
    first = mutate.with_serials(own, rows.filter("id < 5000"), rows.filter("false"))
    rest = mutate.with_serials(own, rows.filter("id >= 5000"), first)
    return first.unionByName(rest).select("id", "customer_id", F.col("serial").cast("long").alias("serial"))


@query("SELECT max(id) AS last, 'Orders' AS entity FROM e_orders UNION ALL SELECT max(c_custkey), 'Customer' FROM customer")
def max_clock(spark, sf):
    """A6, C18"""
    w = b.world(spark, sf)
    return evolve.clocks({n: w.tables[n] for n in ("Orders", "Customer")})


@query("SELECT customer_id, max(total_cents) AS last FROM e_orders GROUP BY 1")
def group_max_serial(spark, sf):
    """A7"""
    return b.world(spark, sf).history("Orders").groupBy("customer_id").agg(F.max("total_cents").alias("last"))


# ---- changes to entities ----------------------------------------------------

@query("""SELECT 1000000 + row_number() OVER (ORDER BY c_name, c_mktsegment, c_nationkey) - 1 AS id, c_name AS name, CAST(0 AS BIGINT) AS balance_cents FROM customer""")
def insert_batch(spark, sf):
    """K3: ids, defaults and checks of a batch"""
    w = b.world(spark, sf)
    own = w.schema.entity("Customer")
    own = replace(own, fields=tuple(replace(f, default=0) if f.name == "balance_cents" else f for f in own.fields))
    w = type(w)(w.schema.with_entity(own), w.tables, w.edges, w.now)
    values = w.rows("Customer").select("name", "segment", "nation_id")
    return mutate.insert(w, "Customer", values, 1_000_000).tables["Customer"].filter("id >= 1000000").select("id", "name", "balance_cents")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer")
def update_batch(spark, sf):
    """K4"""
    w = b.world(spark, sf)
    new = w.equal("Customer", {"nation_id": 3}).select("id", F.lit("MOVED").alias("segment"))
    return mutate.update(w, "Customer", new).tables["Customer"].select("id", "segment")


@query("SELECT r AS rgt, count(*) AS n FROM (SELECT r FROM edges UNION ALL SELECT 3 FROM e_orders WHERE id IN (SELECT id FROM live_orders) AND id % 50 = 0 AND id NOT IN (SELECT l FROM edges WHERE r = 3)) GROUP BY 1")
def connect_batch(spark, sf):
    """K5"""
    w = b.world(spark, sf)
    have = w.relation("Orders", "parts").filter("right = 3").select(F.col("left").alias("id"))
    pairs = w.rows("Orders").filter("id % 50 = 0").join(have, "id", "left_anti").select(F.col("id").alias("left"), F.lit(3).cast("long").alias("right"), F.lit(1).cast("long").alias("qty"), F.lit("N").alias("returnflag"))
    edges = mutate.connect(w, "Orders", "parts", pairs, 10**13).edges["Orders.parts"]
    return edges.groupBy(F.col("right").alias("rgt")).agg(F.count("*").alias("n"))


@query("SELECT CAST(round(o_totalprice) AS BIGINT) AS whole, o_orderkey AS id FROM orders WHERE regexp_matches(CAST(o_orderkey % 100 AS VARCHAR), '^(0|[1-9][0-9]*)$')")
def evolve_cast(spark, sf):
    """F3, F4, C9"""
    rows = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").cast("string").alias("t"), (F.col("o_orderkey") % 100).cast("string").alias("k"))
    return rows.filter(is_int_text(F.col("k"))).select(convert(F.col("t"), "text", "int").alias("whole"), "id")


@query("SELECT id, coalesce(note, 'none') AS note, CASE WHEN urgent THEN 'true' ELSE 'false' END AS urgent FROM live_orders")
def evolve_default(spark, sf):
    """A generation copy with a cast and a default"""
    old = b.SCHEMA.entity("Orders")
    swap = {"note": {"optional": False, "default": "none"}, "urgent": {"kind": "text"}}
    new = replace(old, fields=tuple(replace(f, **swap.get(f.name, {})) for f in old.fields))
    return evolve.copied(old, new, b.orders(spark, sf), NOW).select("id", "note", "urgent")


@query("SELECT id, total_cents FROM e_orders WHERE total_cents < 1000000 OR total_cents > 49000000")
def rule_violations(spark, sf):
    """F6, C9"""
    from ..functions.columns import violates

    return b.orders(spark, sf).filter(violates(F.col("total_cents"), low=1_000_000, high=49_000_000)).select("id", "total_cents")


@query("SELECT id FROM e_orders EXCEPT SELECT id FROM live_orders")
def generation_diff(spark, sf):
    """G1"""
    rows = b.orders(spark, sf)
    return evolve.dropped_keys(rows, evolve.copied(b.SCHEMA.entity("Orders"), b.SCHEMA.entity("Orders"), rows, NOW))


@query("SELECT id FROM e_orders INTERSECT SELECT id FROM live_orders")
def generation_kept(spark, sf):
    """G2"""
    rows = b.orders(spark, sf)
    return evolve.kept_keys(rows, evolve.copied(b.SCHEMA.entity("Orders"), b.SCHEMA.entity("Orders"), rows, NOW))


@query("SELECT id, coalesce(note, '<none>') AS note, concat('k', lower(hex(encode(status))), '-', CAST(created_at // 86400 AS VARCHAR)) AS place, sha256(priority) AS digest FROM e_orders")
def scalar_functions(spark, sf):
    """F5, F7, F8"""
    rows = b.orders(spark, sf)
    return rows.select("id", filled(F.col("note"), "<none>").alias("note"), partition_id(F.col("status"), F.expr("created_at div 86400")).alias("place"), F.sha2("priority", 256).alias("digest"))


# ---- documents --------------------------------------------------------------

@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def doc_equal(spark, sf):
    """P14, F10, S12"""
    return docs.select(b.event_documents(spark, sf), [docs.Equal("/k", 69)], [("k", "/k")]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id % 5 = 0")
def doc_null_is_value(spark, sf):
    """Null is a value, not an absence"""
    rows = docs.select(b.text_documents(spark, sf), [docs.Equal("/lang", "en"), docs.Equal("/source", None)], [])
    none = docs.select(b.text_documents(spark, sf), [docs.Missing("/source")], []).select("id")
    return rows.select("id").join(none, "id", "left_anti")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'de'")
def doc_missing(spark, sf):
    """P14"""
    return docs.select(b.text_documents(spark, sf), [docs.Missing("/absent/deep"), docs.Equal("/lang", "de")], []).select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '\"' || source || '\"' END AS source, CAST(n_chars % 10 AS VARCHAR) AS ab, CAST(2 AS BIGINT) AS n FROM documents WHERE lang = 'fr'")
def doc_project(spark, sf):
    """Missing paths are left out"""
    found = docs.select(b.text_documents(spark, sf), [docs.Equal("/lang", "fr")], [("s", "/source"), ("ab", "/x/a~1b"), ("no", "/absent")])
    return found.select("id", F.col("fields")["s"].alias("source"), F.col("fields")["ab"].alias("ab"), F.size("fields").cast("long").alias("n"))


@query("SELECT doc_id AS id, 'kind /source' AS problem FROM documents WHERE doc_id % 5 = 0")
def shape_violations(spark, sf):
    """F11"""
    shape = docs.obj(lang=docs.TEXT, source=docs.TEXT, x=docs.ANY, text=docs.nullable(docs.TEXT))
    return docs.violations(b.text_documents(spark, sf), shape)


@query("SELECT doc_id AS id, 'kind /x/a~1b' AS problem FROM documents")
def shape_violations_nested(spark, sf):
    """nested shapes"""
    shape = docs.obj(lang=docs.TEXT, source=docs.nullable(docs.TEXT), x=docs.mapping(docs.TEXT), text=docs.nullable(docs.TEXT))
    return docs.violations(b.text_documents(spark, sf), shape)


@query("SELECT doc_id AS id, lang AS token FROM documents")
def doc_read(spark, sf):
    """The payload of the head's token"""
    rows = b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("token"))
    payloads = rows.unionByName(rows.select("id", F.lit("old").alias("token")))
    heads = rows.withColumn("collection", F.lit("c"))
    return docs.current(heads, payloads).select("id", "token")


# ---- policy -----------------------------------------------------------------

_WHO = Principal(7)


def _as(spark, sf, f, grants, who=_WHO):
    return run_as(b.world(spark, sf), f, grants, who)


@query(f"SELECT {ORDER} FROM live_orders WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR id = 11")
def policy_row_subtree(spark, sf):
    """C1, C2, C3, C5"""
    grants = [Grant("7", "see", "Nation", row=3), Grant("all", "*", "Orders", row=11), Grant("8", "see", "Orders"), Grant("7", "set", "Orders")]
    return _as(spark, sf, form("Orders"), grants).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE status = 'P' OR total_cents > 40000000 AND priority = '5-LOW'")
def policy_pred(spark, sf):
    """C4"""
    grants = [Grant("anon", "see", "Orders", tests=(Test("status", "=", "P"),)), Grant("7", "see", "Orders", tests=(Test("total_cents", ">", "40000000"), Test("priority", "=", "5-LOW")))]
    return _as(spark, sf, form("Orders"), grants).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE customer_id = 7")
def policy_me(spark, sf):
    """C4: the operator's own id in a predicate"""
    return _as(spark, sf, form("Orders"), [Grant("all", "see", "Orders", tests=(Test("customer_id", "=", ME),))]).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM live_orders WHERE customer_id IN (SELECT id FROM e_customer WHERE segment = 'BUILDING')")
def policy_ancestor_pred(spark, sf):
    """C4: a predicate on an owner"""
    return _as(spark, sf, form("Orders"), [Grant("7", "see", "Customer", tests=(Test("segment", "=", "BUILDING"),))]).rows.select(*_ORDER)


@query(f"SELECT {ORDER} FROM (SELECT * FROM live_orders ORDER BY total_cents DESC, id LIMIT 100) WHERE priority = '1-URGENT'")
def policy_page_then_filter(spark, sf):
    """T4"""
    f = form("Orders").order("total_cents", descending=True).top(100)
    return _as(spark, sf, f, [Grant("7", "see", "Orders", tests=(Test("priority", "=", "1-URGENT"),))]).rows.select(*_ORDER)


@query("SELECT count(*) AS count FROM (SELECT * FROM live_orders ORDER BY total_cents DESC, id LIMIT 300) WHERE priority = '1-URGENT'")
def policy_count(spark, sf):
    """A2"""
    f = form("Orders").order("total_cents", descending=True).top(300).count()
    return _as(spark, sf, f, [Grant("7", "see", "Orders", tests=(Test("priority", "=", "1-URGENT"),))]).count


@query("""+ page AS (SELECT id FROM (SELECT * FROM live_orders ORDER BY total_cents DESC, id LIMIT 50) WHERE status = 'O')
SELECT id, l, r FROM held_edges WHERE l IN (SELECT id FROM page) AND r IN (SELECT p_partkey FROM part WHERE p_size < 20)""")
def policy_links(spark, sf):
    """Edges need a visible row on both ends"""
    grants = [Grant("7", "see", "Orders", tests=(Test("status", "=", "O"),)), Grant("7", "see", "Part", tests=(Test("size", "<", "20"),))]
    links = _as(spark, sf, form("Orders").order("total_cents", descending=True).top(50).link("parts"), grants).links["Orders.parts"]
    return links.select("id", F.col("left").alias("l"), F.col("right").alias("r"))


# ---- change feed ------------------------------------------------------------

def _log(spark, sf):
    verb = F.element_at(F.array(*map(F.lit, ("put", "set", "end"))), (F.col("event_id") % 3 + 1).cast("int"))
    return b.table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"), verb.alias("verb"), F.lit("Orders").alias("unit"), (F.col("event_id") % 20_000).alias("key"), F.col("event_type").alias("who"))


_LOG = "+ log AS (SELECT event_id + 1 AS id, CASE event_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'set' ELSE 'end' END AS verb, event_id % 20000 AS key FROM events), top AS (SELECT max(id) AS m FROM log)"


@query(f"{_LOG} SELECT id, verb, key FROM log WHERE id > (SELECT m - 1000 FROM top)")
def feed_after_cursor(spark, sf):
    """S14"""
    log = _log(spark, sf)
    last = log.agg(F.max("id")).first()[0]
    return changes.after(log, last - 1000).select("id", "verb", "key")


@query(f"{_LOG} SELECT id, verb, key FROM log WHERE id > (SELECT m - 4096 FROM top)")
def feed_window(spark, sf):
    """W2"""
    return changes.kept(_log(spark, sf)).select("id", "verb", "key")


@query(f"{_LOG} SELECT id, verb, key FROM log WHERE key IN (SELECT id FROM live_orders WHERE status = 'O')")
def feed_visible(spark, sf):
    """W3"""
    grants = [Grant("7", "see", "Orders", tests=(Test("status", "=", "O"),))]
    return changes.heard(b.world(spark, sf), _log(spark, sf), grants, _WHO).select("id", "verb", "key")


# ---- stored and streamed ----------------------------------------------------

@query(f"SELECT moment, usr, value_cents FROM e_events WHERE moment >= {_FROM} AND moment < {_TO} AND event_type = 'click'")
def event_store(spark, sf):
    """Written as sorted parts and read back through pruned partitions"""
    path = fresh_path(spark, "events")
    ev.write(EVENTS, b.events(spark, sf), path)
    q = ev.EventQuery(_FROM, _TO, {"event_type": "click"}, ("moment", "user", "value_cents"))
    return ev.select(EVENTS, ev.read(spark, EVENTS, path), q).withColumnRenamed("user", "usr")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 6 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT 5000000 + row_number() OVER (ORDER BY s_name) - 1, 'NEW' FROM supplier""")
def snapshot_batches(spark, sf):
    """Two batches, each a new table that is written and read back under the schema of its manifest"""
    w = b.world(spark, sf)
    schema = Schema.read(w.schema.manifest())

    def kept(world, batch):
        tables = dict(world.tables)
        for name, rows in batch.tables.items():
            path = fresh_path(spark, "batch")
            rows.write.parquet(path)
            tables[name] = spark.read.schema(schema.entity(name).struct()).parquet(path)
        return type(world)(schema, tables, world.edges, world.now)

    w = kept(w, mutate.update(w, "Customer", w.rows("Customer").filter("nation_id < 6").select("id", F.lit("MOVED").alias("segment"))))
    values = b.world(spark, sf).rows("Supplier").select("name", F.lit("NEW").alias("segment"), F.lit(0).cast("long").alias("balance_cents"), "nation_id")
    return kept(w, mutate.insert(w, "Customer", values, 5_000_000)).rows("Customer").select("id", "segment")


@query(f"{_LOG} SELECT id, verb, key FROM log WHERE verb IN ('put', 'end') AND key IN (SELECT id FROM live_orders)")
def feed_tail(spark, sf):
    """The log tailed as a stream, filtered, and delivered to a sink"""
    log, out = fresh_path(spark, "log"), fresh_path(spark, "delivered")
    _log(spark, sf).write.parquet(log)
    live_ids = b.world(spark, sf).rows("Orders").select(F.col("id").alias("key"))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = changes.tail(spark, log)
    changes.deliver(stream, sink, fresh_path(spark, "place"), units=["Orders"], verbs=["put", "end"], see=lambda rows: rows.join(live_ids, "key", "left_semi")).awaitTermination()
    return spark.read.schema(changes.LOG).parquet(out).select("id", "verb", "key")


@query("SELECT DISTINCT event_type AS k, CAST(user_id AS BIGINT) AS v FROM events")
def stream_append_once(spark, sf):
    """Rows of one token are appended once"""
    source, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    b.table(spark, sf, "events").select(F.col("event_type").alias("k"), F.col("user_id").alias("v")).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 2).parquet(source)
    changes.append_once(stream, out, fresh_path(spark, "ledger"), fresh_path(spark, "place"), ["k", "v"]).awaitTermination()
    return spark.read.schema("k string, v long").parquet(out).select("k", "v")


# ---- further operators ------------------------------------------------------

def _told(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver found out."""
    return spark.createDataFrame(rows, schema)


@query("SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY id) AS serial FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN customer_id END AS scope FROM e_orders)")
def serial_null_scope(spark, sf):
    """Rows without a scope count among themselves"""
    own = Entity("Orders", (Field("serial", "int", serial=("scope",)),))
    rows = b.orders(spark, sf).select("id", F.when(F.col("id") % 5 != 0, F.col("customer_id")).alias("scope"), F.lit(None).cast("long").alias("serial"))
    return mutate.with_serials(own, rows, rows.filter("false"))


@query("SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS segment FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey <> 3")
def unset_batch(spark, sf):
    """K4: an optional field becomes absent"""
    w = b.world(spark, sf)
    own = w.schema.entity("Customer")
    own = replace(own, fields=tuple(replace(f, optional=True) if f.name == "segment" else f for f in own.fields))
    w = type(w)(w.schema.with_entity(own), w.tables, w.edges, w.now)
    return mutate.update(w, "Customer", w.equal("Customer", {"nation_id": 3}).select("id"), unset=("segment",)).tables["Customer"].select("id", "segment")


@query("""SELECT id, CASE WHEN qty > 40 AND r IN (SELECT p_partkey FROM part) AND l IN (SELECT id FROM live_orders) THEN 'X' ELSE returnflag END AS returnflag FROM edges""")
def tune_batch(spark, sf):
    """K5: fields of live edges with live ends; the ends name an edge too, as for ``cut_batch``"""
    w = b.world(spark, sf)
    lefts = w.rows("Orders").select(F.col("id").alias("left"))
    asked = w.held_edges("Orders", "parts").filter("qty > 40").join(lefts, "left", "left_semi").select(*mutate.EDGE, F.lit("X").alias("returnflag"))
    return mutate.tune(w, "Orders", "parts", asked).edges["Orders.parts"].select("id", "returnflag")


@query(f"SELECT id, CASE WHEN qty < 10 THEN CAST({NOW} AS BIGINT) END AS expires_at FROM edges")
def cut_batch(spark, sf):
    """K5: edges ended; beyond a million parts ids are shared, so the ends name an edge too"""
    w = b.world(spark, sf)
    return mutate.disconnect(w, "Orders", "parts", w.edges["Orders.parts"].filter("qty < 10").select(*mutate.EDGE)).edges["Orders.parts"].select("id", "expires_at")


@query(f"SELECT id, CASE WHEN status = 'O' AND (expires_at IS NULL OR expires_at > {NOW}) THEN CAST({NOW + 60} AS BIGINT) ELSE expires_at END AS expires_at FROM e_orders")
def lease_batch(spark, sf):
    """Live rows leased"""
    w = b.world(spark, sf)
    ends = w.equal("Orders", {"status": "O"}).select("id", F.lit(NOW + 60).cast("long").alias("expires_at"))
    return mutate.lease(w, "Orders", ends).tables["Orders"].select("id", "expires_at")


def _refused(change) -> bool:
    try:
        change()
    except (mutate.Refused, ev.EventError, docs.DocumentError, QueryError, SchemaError, graph.GraphError, LiteralError):
        return True
    return False


_CASES = "batch size,bytes,candidates,duration,evolved shape,frozen cut,frozen set,frozen tie,frozen tune,join build,join rows,link cap,nested test,rows,within limits"


@query(f"SELECT unnest(string_split('{_CASES}', ',')) AS test, unnest([t <> 'within limits' FOR t IN string_split('{_CASES}', ',')]) AS refused")
def refusals(spark, sf):
    """What passes a limit or breaks a rule is refused, over the whole tables"""
    w, rows = b.world(spark, sf), _stored_events(spark, sf)
    own = w.schema.entity("Orders")
    cold = type(w)(w.schema.with_entity(replace(own, frozen=True)), w.tables, w.edges, w.now)
    some = w.edges["Orders.parts"].limit(1)
    one = some.select("id", F.lit("X").alias("returnflag"))
    q = ev.EventQuery(_FROM, _TO, columns=("moment", "raw"))
    sides = Side("user", ev.EventQuery(equals={"event_type": "purchase"})), Side("user", ev.EventQuery(equals={"event_type": "signup"}))
    cases = {
        "batch size": lambda: next(ev.batches(ev.select(EVENTS, rows, q), 0)),
        "bytes": lambda: ev.within(EVENTS, rows, q, ev.Budget(bytes=1)),
        "candidates": lambda: ev.within(EVENTS, rows, q, ev.Budget(candidates=1)),
        "duration": lambda: seconds("5 weeks"),
        "evolved shape": lambda: docs.evolve(b.event_documents(spark, sf), docs.obj(k=docs.NUMBER), docs.obj(k=docs.TEXT)),
        "frozen cut": lambda: mutate.disconnect(cold, "Orders", "parts", one.select("id")),
        "frozen set": lambda: mutate.update(cold, "Orders", cold.point("Orders", 77).select("id", F.lit("X").alias("status"))),
        "frozen tie": lambda: mutate.connect(cold, "Orders", "parts", some.select("left", "right"), 10**13),
        "frozen tune": lambda: mutate.tune(cold, "Orders", "parts", one),
        "join build": lambda: join(EVENTS, rows, *sides, "inner", JoinBudget(build_rows=1)),
        "join rows": lambda: join(EVENTS, rows, *sides, "inner", JoinBudget(rows=1)),
        "link cap": lambda: run(w, form("Orders").link("parts"), cap=10),
        "nested test": lambda: selected(w, form("Orders").some("parts", "children", "has", "7")).count(),
        "rows": lambda: ev.within(EVENTS, rows, q, ev.Budget(rows=1)),
        "within limits": lambda: ev.within(EVENTS, rows, q),
    }
    return _told(spark, [(name, _refused(change)) for name, change in cases.items()], "test string, refused boolean")


@query("SELECT CAST(unnest(range(17)) AS INTEGER) AS hop, 'E' || CAST(19 - unnest(range(17)) AS VARCHAR) AS entity, CAST(1 AS BIGINT) AS key")
def owner_depth(spark, sf):
    """Owners are followed for 16 hops"""
    chain = Schema(tuple(Entity(f"E{k}", (), (Reference("up", f"E{k - 1}", owner=True),) if k else ()) for k in range(20)))
    rows = {e.name: spark.createDataFrame([tuple(1 if c.name in ("id", "up_id") else None for c in e.struct())], e.struct()) for e in chain.entities}
    return graph.owner_chain(World(chain, rows, {}, NOW), "E19").select("hop", "entity", "key")


@query("SELECT unnest(['0s', '90s', '5m', '12h', '30d', 'forever']) AS span, unnest(CAST([0, 90, 300, 43200, 2592000, NULL] AS BIGINT[])) AS seconds")
def durations(spark, sf):
    """F13"""
    return _told(spark, [(x, seconds(x)) for x in ("0s", "90s", "5m", "12h", "30d", "forever")], "span string, seconds long")


@query("SELECT 2 AS shapes, 3 AS digests, 'from Orders; status =; parts some (name like); link parts; total_cents desc; limit' AS shape")
def query_shapes(spark, sf):
    """queries that differ in values alone have one shape, and names of their own"""
    base = form("Orders").some("parts", "name", "like", "red").link("parts").order("total_cents", descending=True).top(5)
    some = [form("Orders").when("status", "=", v).some("parts", "name", "like", "red").link("parts").order("total_cents", descending=True).top(5) for v in "FO"]
    shapes, digests = {f.shape() for f in (base, *some)}, {f.digest() for f in (base, *some, replace(base))}
    return _told(spark, [(len(shapes), len(digests), some[0].shape())], "shapes int, digests int, shape string")


def _stored_parts(spark, sf, events=None):
    path = fresh_path(spark, "events")
    ev.write(EVENTS, b.events(spark, sf) if events is None else events, path)
    return ev.read(spark, EVENTS, path)


@query("SELECT moment, usr FROM e_events WHERE event_type = 'view'")
def event_empty_key(spark, sf):
    """K1: an empty partition key is stored and found"""
    blank = b.events(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")))
    return ev.select(EVENTS, _stored_parts(spark, sf, blank), ev.EventQuery(equals={"event_type": ""}, columns=("moment", "user"))).withColumnRenamed("user", "usr")


@query("""SELECT concat('k', lower(hex(encode(event_type))), '-', CAST(moment // """ + str(DAY) + """ AS VARCHAR)) AS partition, count(*) AS rows, CAST(0 AS BIGINT) AS turned FROM e_events GROUP BY 1""")
def sorted_parts(spark, sf):
    """T5: within each file the records of a partition follow their sort keys, then their time"""
    rows = _stored_parts(spark, sf).select(F.concat_ws("-", "p_key", "p_slot").alias("partition"), F.struct(*EVENTS.sort, EVENTS.time).alias("place"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n"))
    before = F.lag("place").over(Window.partitionBy("file").orderBy("n"))  # a file is bounded
    turned = F.coalesce(before > F.col("place"), F.lit(False)).cast("long")
    return rows.withColumn("turned", turned).groupBy("partition").agg(F.count("*").alias("rows"), F.sum("turned").alias("turned"))


@query("SELECT event_type, count(*) AS rows, sum(moment) AS moments FROM e_events GROUP BY 1")
def event_union(spark, sf):
    """Sealed parts and open records are one table"""
    rows = b.events(spark, sf)
    early = F.col("moment") < _FROM
    both = ev.union(_stored_parts(spark, sf, rows.filter(early)), ev.as_stored(EVENTS, rows.filter(~early)))
    moments = F.sum(F.col("moment").cast("decimal(20,0)"))  # a few thousand moments pass 64 bits
    return both.groupBy("event_type").agg(F.count("*").alias("rows"), moments.cast("decimal(38,0)").alias("moments"))


@query(f"""SELECT count(DISTINCT moment // {DAY}) AS partitions, count(*) AS candidates, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS rows, CAST(coalesce(sum(8 + octet_length(unhex(raw))) FILTER (WHERE ok), 0) AS BIGINT) AS bytes
FROM (SELECT *, moment >= {_FROM} + 5 AND moment < {_TO} - 5 AND usr = '46' AS ok FROM e_events WHERE event_type = 'click' AND moment // {DAY} BETWEEN {(_FROM + 5) // DAY} AND {(_TO - 6) // DAY})""")
def event_statistics(spark, sf):
    """Partitions and candidates that a query reads, rows it matches, bytes it is charged"""
    q = ev.EventQuery(_FROM + 5, _TO - 5, {"event_type": "click", "user": "46"}, ("moment", "raw"))
    return ev.statistics(EVENTS, _stored_parts(spark, sf), q)


@query("""SELECT batch, sha256(concat_ws(':', '7', lower(hex(encode('t' || CAST(batch AS VARCHAR)))), string_agg(record, '' ORDER BY event_id))) AS content_token
FROM (SELECT event_id, event_id // 500 AS batch, sha256(concat_ws(':', CAST(moment AS VARCHAR), lower(hex(encode(event_type))), lower(hex(encode(usr))), lower(raw))) AS record FROM e_events) GROUP BY batch""")
def content_tokens(spark, sf):
    """Batches named by operator, token and their records in order"""
    keyed = b.table(spark, sf, "events").select("event_id", F.expr("event_id div 500").alias("batch"), *_event_columns())
    named = keyed.withColumn("operator", F.lit(7)).withColumn("token", F.concat(F.lit("t"), F.col("batch").cast("string")))
    return ev.batch_tokens(EVENTS, named, "operator", "token", "event_id", ["batch"])


def _event_columns():
    return [b.since("MICROSECOND", "ts").alias("moment"), "event_type", F.col("user_id").cast("string").alias("user"), F.encode("props", "UTF-8").alias("raw")]


@query("""SELECT 'table' AS kind, 'Region' AS name, 'rows' AS detail UNION ALL SELECT 'table', 'Part.children', 'edges'
UNION ALL SELECT 'column', 'Region.' || c, t FROM (SELECT unnest(['id', 'name', 'expires_at', 'created_at', 'updated_at']) AS c, unnest(['bigint', 'string', 'bigint', 'bigint', 'bigint']) AS t)
UNION ALL SELECT 'column', 'Part.children.' || c, 'bigint' FROM (SELECT unnest(['id', 'left', 'right', 'expires_at', 'created_at', 'updated_at']) AS c)""")
def catalog_shapes(spark, sf):
    """Tables and columns as they are"""
    w = b.world(spark, sf)
    return evolve.catalog({"Region": w.tables["Region"]}, {"Part.children": w.edges["Part.children"]})


@query("SELECT DISTINCT 'Team ' || CAST(user_id % 50 AS VARCHAR) AS \"group\" FROM events WHERE event_type = 'signup' AND user_id // 50 = 1 AND user_id % 50 % 3 <> 0")
def group_members(spark, sf):
    """The live groups that an operator belongs to through live edges"""
    schema = Schema((Entity("Actor"), Entity("Team", (), (), (Relation("members", "Actor", membership=True),))))
    none = F.lit(None).cast("long")
    times = [none.alias("created_at"), none.alias("updated_at")]
    team = F.col("user_id") % 50
    signed = b.table(spark, sf, "events").filter("event_type = 'signup'")
    teams = signed.select(team.alias("id")).distinct().select("id", F.when(F.col("id") % 3 == 0, F.lit(NOW)).cast("long").alias("expires_at"), *times)
    actors = signed.select(F.expr("user_id div 50").alias("id")).distinct().select("id", none.alias("expires_at"), *times)
    edges = signed.select(F.col("event_id").alias("id"), team.alias("left"), F.expr("user_id div 50").alias("right"), none.alias("expires_at"), *times)
    return memberships(type(b.world(spark, sf))(schema, {"Actor": actors, "Team": teams}, {"Team.members": edges}, NOW), Principal(1))


@query("SELECT doc_id AS id, lang FROM documents WHERE source IS NOT NULL AND lang <> 'fr'")
def doc_inventory(spark, sf):
    """The documents whose head may be seen"""
    heads = b.table(spark, sf, "documents").filter("source is not null and lang <> 'fr'").select(F.lit("c").alias("collection"), F.col("doc_id").alias("id"), F.lit("t").alias("token"))
    found = docs.inventory(b.text_documents(spark, sf), heads)
    return found.select("id", F.variant_get("document", "$.lang", "string").alias("lang"))


@query("""SELECT event_id AS id, '{"k2":[1,null],"more":"x"}' AS j FROM events""")
def doc_patched(spark, sf):
    """values set and removed at pointers"""
    return docs.patched(b.event_documents(spark, sf), {"/k2": [1], "/k2/-": None, "/more": "x"}, ["/k"]).select("id", F.to_json("document").alias("j"))


def _born(spark, sf):
    """Documents of the events, created under a shape that some break."""
    shape = docs.obj(k=docs.NUMBER)
    fresh = b.table(spark, sf, "events").select(F.lit("c").alias("collection"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", F.parse_json(F.lit('{"k":"no"}'))).otherwise(F.parse_json("props")).alias("document"))
    none = fresh.filter("false")
    heads, payloads = none.select("collection", "id", F.lit("").alias("token")), none.select("id", F.lit("").alias("token"), "document")
    return (*docs.create(heads, payloads, fresh, shape), shape)


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_TOKEN = "sha256(concat_ws(':', CAST(event_id AS VARCHAR), {}, '{{\"k\":' || {} || '}}'))"
_FIRST = _TOKEN.format("'0'", f"CAST({_K} AS VARCHAR)")


@query(f"SELECT event_id AS id, {_FIRST} AS token, CAST(NULL AS VARCHAR) AS problem FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL, 'kind /k' FROM events WHERE event_type = 'error'")
def doc_create(spark, sf):
    """Documents of the shape get heads and payloads, others are refused"""
    heads, payloads, refused, _ = _born(spark, sf)
    return docs.current(heads, payloads).select("id", "token", F.lit(None).cast("string").alias("problem")).unionByName(refused.select("id", F.lit(None).cast("string").alias("token"), "problem"))


@query(f"""SELECT event_id AS id, CASE WHEN {_K} < 50 THEN {_TOKEN.format(_FIRST, "'5'")} ELSE {_FIRST} END AS token FROM events WHERE event_type <> 'error' AND event_type <> 'view'""")
def doc_edit_end(spark, sf):
    """Edits on the head's token stand, stale ones don't; ended documents are gone"""
    heads, payloads, _, shape = _born(spark, sf)
    k = docs.current(heads, payloads).select("id", "token", F.variant_get("document", "$.k", "long").alias("k"))
    edits = k.select("id", F.when(F.col("k") < 50, F.col("token")).otherwise(F.lit("stale")).alias("base"))
    heads, _, _ = docs.edit(heads, payloads, edits, shape, {"/k": 5})
    views = b.table(spark, sf, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"))
    left, _ = docs.end(heads, heads.join(docs.shuffled(views), "id", "left_semi").select("id", "token"))
    return left.select("id", "token")


@query("SELECT event_id AS id, props AS j FROM (SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events)")
def doc_evolve(spark, sf):
    """A wider shape, every document validated again"""
    wide = docs.obj(k=docs.nullable(docs.NUMBER), more=(docs.nullable(docs.TEXT), False))
    return docs.evolve(b.event_documents(spark, sf), docs.obj(k=docs.NUMBER), wide).select("id", F.to_json("document").alias("j"))


@query(f"""{_LOG}, fresh AS (SELECT id AS key, CASE WHEN status = 'O' THEN 'put' ELSE 'set' END AS verb FROM live_orders)
SELECT id, verb, key FROM log UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY verb, key), verb, key FROM fresh""")
def log_append(spark, sf):
    """A batch's changes as further entries"""
    log = _log(spark, sf)
    rows = b.world(spark, sf).rows("Orders").select(F.when(F.col("status") == "O", F.lit("put")).otherwise(F.lit("set")).alias("verb"), F.lit("Orders").alias("unit"), F.col("id").alias("key"))
    return changes.appended(log, rows, "7", log.agg(F.max("id")).first()[0]).select("id", "verb", "key")


@query("""+ box AS (SELECT CAST(NULL AS VARCHAR) AS field, id AS key FROM e_orders WHERE id NOT IN (SELECT id FROM live_orders) UNION ALL SELECT 'note', id FROM live_orders WHERE note IS NOT NULL)
SELECT 'Orders' AS entity, field, key FROM box WHERE NOT (field IS NULL AND key % 2 = 0)""")
def outbox_left(spark, sf):
    """What a generation drops, without what is acknowledged"""
    own = b.SCHEMA.entity("Orders")
    thin = replace(own, fields=tuple(f for f in own.fields if f.name != "note"))
    rows = b.orders(spark, sf)
    pick = lambda e: Schema((replace(e, references=(), relations=()),))
    box = evolve.outbox(pick(own), pick(thin), {"Orders": rows}, {"Orders": evolve.copied(own, thin, rows, NOW)})
    return changes.acknowledged(box, box.filter("field is null and key % 2 = 0"))


@query("SELECT id FROM live_orders WHERE status = 'O' AND total_cents - 5000000 > 10000000 UNION SELECT id FROM live_orders WHERE customer_id = 11")
def change_allowed_rows(spark, sf):
    """The old row must be covered, and the new cells too, under the old row's owners"""
    w = b.world(spark, sf)
    grants = [Grant("7", "see", "Orders"), Grant("7", "set", "Orders", tests=(Test("status", "=", "O"), Test("total_cents", ">", "10000000"))), Grant("7", "set", "Customer", row=11)]
    after = w.rows("Orders").withColumn("total_cents", F.col("total_cents") - 5_000_000)
    return change_allowed(w, "Orders", after, grants, _WHO)


@query("SELECT '7' AS who, '*' AS verb, 'Orders' AS unit, 'row ' || CAST(id AS VARCHAR) AS scope FROM live_orders WHERE customer_id <> 11")
def minted_grants(spark, sf):
    """A creator's grants on rows that no other grant covers"""
    w = b.world(spark, sf)
    return minted(w, "Orders", w.rows("Orders"), [Grant("7", "*", "Customer", row=11)], _WHO)


@query("SELECT unnest(['all orders', 'every unit', 'own row', 'row of an owner', 'row unseen', 'verb unheld']) AS asked, unnest([false, false, true, true, false, false]) AS allowed")
def grants_handed_on(spark, sf):
    """Only what is held can be granted"""
    w = b.world(spark, sf)
    own = w.rows("Orders").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.min_by("customer_id", "id").alias("c"), F.max_by("customer_id", "id").alias("d")).first()
    under = w.rows("Orders").filter((F.col("customer_id") == own["d"])).agg(F.max("id")).first()[0]
    grants = [Grant("7", "*", "Orders", row=own["id"]), Grant("7", "see", "Customer", row=own["d"])]
    cases = {"all orders": Grant("8", "see", "Orders"), "every unit": Grant("8", "see", "*"), "own row": Grant("8", "set", "Orders", row=own["id"]), "row of an owner": Grant("8", "see", "Orders", row=under), "row unseen": Grant("8", "see", "Orders", row=-3), "verb unheld": Grant("8", "set", "Orders", row=under)}
    return _told(spark, [(name, may_grant(w, g, grants, _WHO)) for name, g in cases.items()], "asked string, allowed boolean")


@query("""SELECT unnest(['add', 'alter', 'cast', 'drop', 'drop']) AS action, unnest(['Orders.flag', 'Orders.note', 'Orders.urgent', 'Orders.priority', 'Supplier.Supplier']) AS name, unnest(['', 'present', 'values', 'authority', 'clear,authority']) AS needs""")
def schema_delta(spark, sf):
    """The steps between two schemas and what each needs of the data"""
    own = b.SCHEMA.entity("Orders")
    swap = {"note": {"optional": False}, "urgent": {"kind": "text"}}
    fields = (*(replace(f, **swap.get(f.name, {})) for f in own.fields if f.name != "priority"), Field("flag", optional=True))
    new = Schema(tuple(replace(e, fields=fields) if e.name == "Orders" else e for e in b.SCHEMA.entities if e.name != "Supplier"))
    return _told(spark, [(s.action, f"{s.entity}.{s.name}", ",".join(s.needs)) for s in evolve.difference(b.SCHEMA, new)], "action string, name string, needs string")


@query("""SELECT 'cast' AS action, 'total_cents' AS name, 'values' AS need UNION ALL SELECT 'alter', 'note', 'present' WHERE EXISTS (SELECT 1 FROM live_orders WHERE note IS NULL)""")
def schema_unmet(spark, sf):
    """The needs that live rows don't satisfy"""
    own = b.SCHEMA.entity("Orders")
    swap = {"note": {"optional": False}, "total_cents": {"kind": "bool"}}
    new = b.SCHEMA.with_entity(replace(own, fields=tuple(replace(f, **swap.get(f.name, {})) for f in own.fields)))
    found = evolve.unmet(b.SCHEMA, new, {"Orders": b.orders(spark, sf)}, NOW)
    return _told(spark, [(s.action, s.name, need) for s, need in found], "action string, name string, need string")
