"""Registered queries against their SQL where values are those of larger tables."""

import duckdb

from millrace.plans.queries import QUERIES, SQL


def agrees(spark, folder, name, tables):
    """A query's rows over ``tables``, written to a folder, after they are held against the SQL's."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    found = con.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted(found, key=str)
    return rows


def test_sums_of_moments_pass_64_bits(spark, tmp_path):
    ts = "timestamp_ntz'2024-01-05 00:00:00' + make_interval(0, 0, 0, cast(id % 2 * 15 as int)) AS ts"
    events = spark.range(12_000).selectExpr("id AS event_id", ts, "id AS user_id", "'click' AS event_type", "1.0D AS value", """'{"k": 1}' AS props""")
    ((_, rows, moments),) = agrees(spark, tmp_path, "event_union", {"events": events})
    assert rows == 12_000 and moments > 2**63


def orders_of_a_million_parts(spark):
    """Orders 1 and 2 and their parts: edge 1-1000005 shares its id with edge 2-5, 1-1000006 with 2-6."""
    lines = [(1, 1_000_005, 5.0), (2, 5, 45.0), (1, 1_000_006, 45.0), (2, 6, 5.0), (1, 1_000_007, 45.0), (2, 7, 45.0), (1, 8, 5.0), (2, 8, 20.0), (1, 1_000_009, 5.0), (2, 9, 5.0)]
    return {
        "lineitem": spark.createDataFrame([(o, p, q, "N") for o, p, q in lines], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
        "part": spark.createDataFrame([(p, "part", "brand", "type", 1) for _, p, _ in lines if p != 8], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").distinct(),
        "orders": spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, 1.0D AS o_totalprice, timestamp_ntz'1996-01-02 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(1, 3)"),
    }


def test_cut_edges_that_share_an_id(spark, tmp_path):
    rows = agrees(spark, tmp_path, "cut_batch", orders_of_a_million_parts(spark))
    assert sorted(r[0] for r in rows if r[1]) == [1_000_008, 2_000_005, 2_000_006, 2_000_009, 2_000_009]


def test_tuned_edges_that_share_an_id(spark, tmp_path):
    rows = agrees(spark, tmp_path, "tune_batch", orders_of_a_million_parts(spark))
    assert sorted(r[0] for r in rows if r[1] == "X") == [2_000_005, 2_000_006, 2_000_007, 2_000_007] and len(rows) == 10
