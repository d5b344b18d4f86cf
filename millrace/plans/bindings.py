"""The generated tables as entities, relations, events and documents, in Spark and in SQL.

Money becomes integer cents, times become integers since 1970. Orders get a
lifetime: those of status F end 90 days after their date, the others never; ``NOW``
is a fixed reading time. ``PRELUDE`` defines the same tables in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.world import World
from ..sources.events import EventTable
from ..sources.schema import Entity, Field, Reference, Relation, Schema

NOW = 883_612_800
LEASE = 7_776_000
DAY = 86_400_000_000

SCHEMA = Schema(
    (
        Entity("Region", (Field("name"),)),
        Entity("Nation", (Field("name"),), (Reference("region", "Region", owner=True),)),
        Entity("Customer", (Field("name"), Field("segment"), Field("balance_cents", "int")), (Reference("nation", "Nation", owner=True),)),
        Entity("Supplier", (Field("name"), Field("balance_cents", "int")), (Reference("nation", "Nation", owner=True),)),
        Entity("Part", (Field("name"), Field("brand"), Field("type"), Field("size", "int")), relations=(Relation("children", "Part", closure=True),)),
        Entity(
            "Orders",
            (Field("status"), Field("priority"), Field("total_cents", "int"), Field("note", optional=True), Field("urgent", "bool")),
            (Reference("customer", "Customer", owner=True),),
            (Relation("parts", "Part", (Field("qty", "int"), Field("returnflag"))),),
        ),
    )
)

EVENTS = EventTable("moment", ("event_type", "user"), DAY, "event_type", ("user",), (("value_cents", "int"), ("flag", "bool")), raw="raw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def since(unit: str, name: str) -> Column:
    """Whole units since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def _entity(df: DataFrame, name: str) -> DataFrame:
    """``df`` with absent system columns added, in the entity's columns and types."""
    own = SCHEMA.entity(name).struct()
    return df.select(*((F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in own))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = since("SECOND", "o_orderdate")
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        cents("o_totalprice").alias("total_cents"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", created + LEASE).alias("expires_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
    return _entity(base, "Orders")


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each order and part that a line item joins."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_quantity").cast("long").alias("qty"), F.min("l_returnflag").alias("returnflag"))
    none = F.lit(None).cast("long")
    return lines.select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("left"), F.col("l_partkey").alias("right"), "qty", "returnflag", none.alias("expires_at"), none.alias("created_at"), none.alias("updated_at"))


def part_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p is a child of part p div 10."""
    none = F.lit(None).cast("long")
    return table(spark, sf_dir, "part").filter("p_partkey >= 1").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 10").alias("left"), F.col("p_partkey").alias("right"), none.alias("expires_at"), none.alias("created_at"), none.alias("updated_at"))


class Lazy(Mapping):
    """Tables that are opened when they are asked for: a query reads the footers of its own tables only."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def world(spark: SparkSession, sf_dir: str, now: int = NOW) -> World:
    t = lambda name: table(spark, sf_dir, name)
    tables = {
        "Region": lambda: _entity(t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "Region"),
        "Nation": lambda: _entity(t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id")), "Nation"),
        "Customer": lambda: _entity(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), cents("c_acctbal").alias("balance_cents"), F.col("c_nationkey").alias("nation_id")), "Customer"),
        "Supplier": lambda: _entity(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), cents("s_acctbal").alias("balance_cents"), F.col("s_nationkey").alias("nation_id")), "Supplier"),
        "Part": lambda: _entity(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")), "Part"),
        "Orders": lambda: orders(spark, sf_dir),
    }
    edges = {"Orders.parts": lambda: order_parts(spark, sf_dir), "Part.children": lambda: part_children(spark, sf_dir)}
    return World(SCHEMA, Lazy(tables), Lazy(edges), now)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        since("MICROSECOND", "ts").alias("moment"),
        "event_type",
        F.col("user_id").cast("string").alias("user"),
        F.encode("props", "UTF-8").alias("raw"),
        cents("value").alias("value_cents"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") > 50).alias("flag"),
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.parse_json("props").alias("document"))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several paths: language, source (null for every fifth), size and the whole text."""
    body = F.struct("lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), F.struct((F.col("n_chars") % 10).alias("a/b")).alias("x"), "text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.parse_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("document"))


#: The same tables for SQL.
PRELUDE = f"""
e_orders AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note, o_orderpriority = '1-URGENT' AS urgent, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) + {LEASE} END AS expires_at, CAST(epoch(o_orderdate) AS BIGINT) AS created_at
  FROM orders),
live_orders AS (SELECT * FROM e_orders WHERE expires_at IS NULL OR expires_at > {NOW}),
edges AS (
  SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey AS l, l_partkey AS r, CAST(min(l_quantity) AS BIGINT) AS qty, min(l_returnflag) AS returnflag
  FROM lineitem GROUP BY l_orderkey, l_partkey),
held_edges AS (SELECT * FROM edges WHERE r IN (SELECT p_partkey FROM part)),
e_customer AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents, c_nationkey AS nation_id FROM customer),
e_events AS (
  SELECT epoch_us(ts) AS moment, event_type, CAST(user_id AS VARCHAR) AS usr, hex(encode(props)) AS raw, CAST(round(value * 100) AS BIGINT) AS value_cents,
         CASE WHEN event_id % 4 <> 0 THEN value > 50 END AS flag, event_id FROM events),
children AS (SELECT CAST(p_partkey // 10 AS BIGINT) AS l, p_partkey AS r FROM part WHERE p_partkey >= 1)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A query over the prelude's tables; ``body`` may begin with further tables."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    joint = "," if body.lstrip().startswith("+") else ""
    return f"{head} {PRELUDE}{joint} {body.lstrip().removeprefix('+')}"
