import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import ROWS, Planted, documents, empty, table
from millrace.llm import common
from millrace.llm import ngramjoin as j

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def by_hand(rows):
    sets, root, n = {i: grams(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first = defaultdict(lambda: 1 << 60)
    for i in ids:
        first[sets[i]] = min(first[sets[i]], i)
    return sorted(((i, find(i), n[i], first[sets[i]] if sets[i] else i) for i in ids), key=str)


def _rows():
    p, rows = Planted(8), []
    for g in range(8):
        base = p.words(120)
        for k in range(6):
            words = list(base)
            for _ in range(k):  # 0 to 5 words changed: similarities from 1 down to below 0.8
                words[p.r.randrange(120)] = "changed"
            rows.append(" ".join(words))
        rows.append(" ".join(base).upper())
        rows.append(" ".join(base[:60]) + " " + p.text(80))  # shares a passage only
    rows += ["one two", "One, two!", "three", None, "", "  ", p.text(5), p.text(400)]
    chain = p.words(200)
    for k in range(8):  # each near the next, the ends far apart
        rows.append(" ".join(chain[10 * k : 10 * k + 110]))
    return [(k * 3, t, None) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block, hot", [(1024, 256), (3, 2)])
def test_against_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(j, "BLOCK_TEXTS", block)  # 3: components in many pairs of blocks, or by buckets
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # 2: most keys are broadcast
    rows = _rows()
    assert table(j.near_groups(documents(spark, rows)), "doc_id", "class_id", "n_links", "set_id") == by_hand(rows)
    if hot > 2:
        return
    kept = table(j.keep_one(documents(spark, rows)), "doc_id")
    assert kept == sorted({(c,) for _, c, _, _ in by_hand(rows)}, key=str)


def test_a_group_of_near_copies_gives_rows_of_its_texts_alone(spark):
    p = Planted(3)
    base = p.words(200)
    rows = [(k, " ".join([*base[:150], f"only{k}", *base[150:]]), None) for k in range(300)]
    got = table(j.near_groups(documents(spark, rows)), "doc_id", "class_id", "n_links")
    assert got == sorted(((k, 0, 299) for k in range(300)), key=str)


def test_edges(spark):
    got = table(j.near_groups(documents(spark)), "doc_id", "class_id", "n_links")
    assert len(got) == len(ROWS)
    assert (1, 1, 1) in got and (7, 1, 1) in got and (8, 8, 1) in got and (2, 2, 0) in got and (4, 4, 0) in got
    assert j.near_groups(empty(spark)).collect() == []
    assert j.keep_one(documents(spark)).columns == documents(spark).columns


def test_a_chain_goes_by_buckets(spark, monkeypatch):
    """Each text near the next few only: fewer texts are sent than by pairs of blocks, and no link is lost or counted twice."""
    p = Planted(14)
    chain = p.words(900)
    rows = [(k, " ".join(chain[4 * k : 4 * k + 100]), None) for k in range(200)]
    monkeypatch.setattr(j, "BLOCK_TEXTS", 4)
    slots = []
    candidates = j._candidates
    monkeypatch.setattr(j, "_candidates", lambda *x: slots.append(candidates(*x)) or slots[-1])
    got = table(j.near_groups(documents(spark, rows)), "doc_id", "class_id", "n_links", "set_id")
    assert got == by_hand(rows) and slots[0].filter("slot >= 0").count() > 200


def test_rows_without_id_stay_in_proportion(spark):
    """Thousands of rows that share an id, or have none, give a row each, and one of a group stays."""
    p = Planted(15)
    base = p.words(80)
    near = [" ".join([*base[:40], f"only{k}", *base[40:]]) for k in range(40)]
    rows = [(None, near[k % 40], None) for k in range(2_000)] + [(5, near[k % 3], "x") for k in range(300)] + [(9, p.text(50), None)]
    docs = documents(spark, rows)
    got = j.near_groups(docs)
    assert got.count() == len(rows) and got.filter("doc_id <> 9").select("class_id").distinct().count() == 1
    assert {r["n_links"] for r in got.filter("doc_id <> 9").collect()} == {2_299}
    kept = j.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 9]
    some = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "a b c d e f", None), (5, None, "z"), (5, None, "z"), (None, "", "q")]
    assert sorted(r["text"] or "-" for r in j.keep_one(documents(spark, some)).collect()) == ["-", "-", "-", "a b c d e f"]


def test_pruning_bound():
    # the posterior that a pair reaches the threshold, against integration of the beta density
    for n, m in ((24, 10), (48, 30), (96, 70)):
        x = np.linspace(0, 1, 200_001)
        density = x**m * (1 - x) ** (n - m)
        posterior = density[x >= 0.8].sum() / density.sum()
        for tolerance in (posterior * 0.99, posterior * 1.01):
            assert (j.least_matches(n, 0.8, tolerance) <= m) == (posterior >= tolerance)


def test_intersections_agree():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(20)]
    pairs = np.array([(a, b) for a in range(20) for b in range(20)])
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert j._exact(sets, sets, pairs).tolist() == want and j._exact(sets, sets, pairs[:7]).tolist() == want[:7]
    keys, offsets = j.ngram_sets(pa.array(["a b c d e f", None, "a b"]))
    assert np.diff(offsets).tolist() == [2, 0, 1]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (20, 10), (10, 1)] + [(k, k + 1) for k in range(100, 140)]
    got = table(j.components(spark.createDataFrame(links, "a long, b long")), "id", "root")
    want = [(k, 1) for k in (1, 2, 3, 10, 20)] + [(8, 8), (9, 8)] + [(k, 100) for k in range(100, 141)]
    assert got == sorted(want, key=str)
