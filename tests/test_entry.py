import os
import re
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_entry_works_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(HERE, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(HERE, "millrace")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [r["total_cents"] for r in rows] == sorted((r["total_cents"] for r in rows), reverse=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
@pytest.mark.parametrize("name", ["live_scan", "some_target_field", "cursor_page", "link_bag", "join_left_present", "closure_pairs", "policy_row_subtree", "doc_project", "feed_visible", "owner_chain"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb
    from millrace.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
