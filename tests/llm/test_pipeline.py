import corpus_pipeline
import pytest
from edge import ROWS, Planted, documents, empty
from millrace.llm import queries as q
from millrace.llm.decontaminate import decontaminated
from millrace.llm.ngramjoin import keep_one


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, p = f"file://{tmp_path_factory.mktemp('tables')}", Planted(21)
    item = p.text(20)
    rows = [(k, p.text(60) + ".", "en", f"s{k % 3}", 0) for k in range(150)]
    rows += [(150 + k, rows[k][1] + " more", "en", "s0", 0) for k in range(10)]  # near copies
    rows += [(160 + k, p.text(30) + " " + item + " " + p.text(30), "en", "s1", 0) for k in range(8)]  # leaks
    rows += [(170 + k, p.text(20) + ". " + "vilka gromt " + p.text(20) + ".", "en", "s2", 0) for k in range(30)]  # toxic
    rows += [(200, None, None, None, None), (201, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(170 <= r[0] < 200)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        docs = docs.persist()
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not ids["toxicity"] & set(range(170, 200)) and len(ids["toxicity"]) >= 165
    assert ids["toxicity"] - ids["near copies"] == set(range(150, 160))
    assert ids["near copies"] - ids["benchmark decontamination"] == set(range(160, 168))
    assert ids["mixing"] <= ids["benchmark decontamination"] and len(ids["mixing"]) > 100
    words = {r["doc_id"]: len(r["text"].split()) for r in docs.filter("text is not null").collect()}
    assert all(words.values())


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    assert len(got) > 150 and set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_all_rows(spark, tables, k):
    """Null, empty and long texts, repeated rows, null ids, clashing columns, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = documents(spark)
    out = stage(spark, docs, tables)
    none = stage(spark, empty(spark), tables)
    assert none.collect() == [] and none.columns == out.columns
    got = out.collect()
    if k == 4:
        assert len(got) == len(ROWS)
        return
    assert out.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in got)
    if name == "near copies":
        assert ids == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    elif name == "mixing":
        assert set(ids) <= {"1", "5", "6", "7", "8", "None"} and ids
    else:
        assert ids == sorted(str(r[0]) for r in ROWS)


def test_token_files_follow_the_mix(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("text is not null").select("doc_id", "text", "source")
    path = f"file://{tmp_path}/mixed"
    docs.orderBy(docs.doc_id.desc()).repartitionByRange(3, docs.doc_id.desc()).sortWithinPartitions(docs.doc_id.desc()).write.parquet(path)
    got = corpus_pipeline.tokens(spark, spark.read.parquet(path), tables).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), reverse=True)


def test_registered():
    names = q.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(q.oracle_sql()) <= set(names)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    """Copies and benchmark passages go, other texts of the same id, or of none, stay."""
    p = Planted(31)
    first, other, item = p.text(60), p.text(60), p.text(40)
    docs = documents(spark, [(1, first, "a"), (2, first, "a"), (2, other, "a"), (None, item, "a"), (None, p.text(30), "b"), (3, None, "b")])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text == first) for r in kept.collect()) == [(0, False), (0, False), (1, True), (2, False), (3, False)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    clean = decontaminated(docs, items)
    assert "Exchange" not in clean._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2, 2, 3]
