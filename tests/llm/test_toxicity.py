import zlib

import numpy as np
import pytest
from edge import CLASH, ROWS, Planted, documents, empty
from millrace.llm import toxicity as t

BAD = ["vilka", "gromt", "sneeb", "plorch"]


def _rows(n=800):
    p, rows, labels = Planted(9), [], []
    for k in range(n):
        lines = [p.text(9) + "." for _ in range(1 + k % 7)]
        toxic = k % 6 == 0
        if toxic:
            at = p.r.randrange(len(lines))
            words = lines[at].split()
            words[2:2] = [p.r.choice(BAD) for _ in range(2)]
            lines[at] = " ".join(words)
        rows.append((k, " ".join(lines), None))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def _labels(spark, rows):
    extra = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"doc_id long, quality int, toxic int, {CLASH}")


def test_held_out_documents_and_sentences(spark):
    rows, labels = _rows()
    got = {r["doc_id"]: r for r in t.toxicity(documents(spark, rows), _labels(spark, labels)).collect()}
    assert len(got) == len(rows)
    right = [got[k]["predicted"] == y for k, _, y in labels if got[k]["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    for k, text, _ in rows:
        r = got[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["predicted"] and k % 6 == 0:
            found = [s for s, x in enumerate(t.sentences(text)) if any(b in x for b in BAD)]
            assert set(found) <= set(r["offending"])
    kept = t.without_toxic(documents(spark, rows), _labels(spark, labels))
    assert kept.columns == documents(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in got if not got[k]["predicted"]}


def test_held_out_labels_do_not_matter(spark):
    rows, labels = _rows(200)
    flipped = [(k, q, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, q, y in labels]
    score = lambda some: sorted((r["doc_id"], r["score"]) for r in t.toxicity(documents(spark, rows), _labels(spark, some)).collect())
    assert score(labels) == score(flipped)


def test_scores_depend_on_the_text_alone(spark):
    rows, labels = _rows(300)
    model = t.fit(*t.sample(documents(spark, rows), _labels(spark, labels)))
    twice = t.score_documents(documents(spark, [(9, rows[6][1], "a"), (10, rows[6][1], "b")]), model).collect()
    assert twice[0]["score"] == twice[1]["score"]


def test_noisy_or(spark):
    model = t.Model({"bad": 4.0, "ba*": 0.5}, -5.0)
    rows = [(1, "Fine here. Very bad, so bad! Fine", None), (2, "fine.", None)]
    got = {r["doc_id"]: r for r in t.score_documents(documents(spark, rows), model).collect()}
    chance = lambda z: 1 / (1 + np.exp(-z))
    assert got[1]["score"] == pytest.approx(1 - (1 - chance(-5)) ** 2 * (1 - chance(-1)))
    assert got[2]["score"] == pytest.approx(chance(-5)) and got[1]["n_sentences"] == 3 and got[1]["offending"] == []


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (7, 1, 1)], [(1, 1, None), (None, 1, 1)]])
def test_edges(spark, labels):
    got = t.toxicity(documents(spark), _labels(spark, labels)).collect()
    assert len(got) == len(ROWS)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4)) and all(0 <= r["score"] <= 1 for r in got)
    assert t.toxicity(empty(spark), _labels(spark, labels)).collect() == []
    assert t.without_toxic(documents(spark), _labels(spark, [])).columns == documents(spark).columns
