import numpy as np
import pyarrow as pa
import pytest
from edge import ROWS, Planted, documents, empty, table
from millrace.llm import decontaminate as c


def _plan(n_items=40):
    p = Planted(12)
    items = [(k, p.text(p.r.choice([6, 14, 25, 40, 60, 150]))) for k in range(n_items)]
    return p, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, None, None) for i, t in items], "item_id long, text string, doc_id long, contaminated boolean")


def edit_distance(a, b):
    """Of ``a`` to the nearest part of ``b``, by the full table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for k, y in enumerate(b, 1):
            row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (x != y)))
    return min(row)


def test_planted_passages(spark):
    p, items = _plan()
    rows, want = [], {}
    for k in range(200):
        words, held = p.words(80), None
        if k % 4 == 0:
            held = items[k // 4 % len(items)]
            passage = held[1].split()
            for _ in range(int(0.1 * len(passage)) if k % 8 == 0 else 0):
                at, kind = p.r.randrange(len(passage)), p.r.randrange(3)
                if kind == 0:
                    passage[at] = "edited"
                elif kind == 1:
                    del passage[at]
                else:
                    passage.insert(at, "added")
            words[30:30] = [w.upper() + "," for w in passage] if k % 12 == 0 else passage
            want[k] = held[0]
        rows.append((k, " ".join(words), None))
    got = {r["doc_id"]: r for r in c.contamination(documents(spark, rows), benchmark(spark, items)).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == set(want)
    assert all(want[k] in got[k]["items"] for k in want)
    kept = c.decontaminated(documents(spark, rows), benchmark(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == set(got) - set(want) and kept.columns == documents(spark, rows).columns


def test_against_brute_force():
    """Every document-item pair within the edits, by a full search; near misses too."""
    p, items = _plan(12)
    texts = []
    for k in range(60):
        passage = items[k % 12][1].split()
        for _ in range(k // 12 * len(passage) // 20):  # up to a fifth of the words changed
            passage[p.r.randrange(len(passage))] = "edited"
        texts.append(" ".join(p.words(20) + passage + p.words(20)))
    searcher = c.Searcher([i for i, _ in items], [t for _, t in items])
    found = searcher.search(pa.array(texts))
    missed = 0
    for text, got in zip(texts, found, strict=True):
        for i, item in items:
            most = int(c.EDITS * len(item.split()))
            d = edit_distance(item.split(), text.split())
            if d <= most:
                missed += i not in got
                assert i not in got or got[i][0] >= d
            else:
                assert i not in got
    assert missed <= 1


def _edited(p, words, kinds=(0, 1, 2)):
    """``words`` with as many edits as an item may have, of the given kinds: replaced, deleted, added."""
    words, n = list(words), int(c.EDITS * len(words))
    for _ in range(n):
        at, kind = p.r.randrange(len(words)), p.r.choice(kinds)
        if kind == 0:
            words[at] = "edited"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "added")
    return words


@pytest.mark.parametrize("size", [7, 14, 20, 40, 100, 300])
def test_most_edits_are_found_at_every_size(size):
    """Short items beside them, which always collide, don't lower the repetitions."""
    p = Planted(31)
    items = [p.words(size) for _ in range(40)] + [p.words(5) for _ in range(200)]
    texts = [p.words(30) + _edited(p, items[k % 40]) + p.words(30) for k in range(160)]
    found = c.Searcher(list(range(240)), [" ".join(x) for x in items]).search(pa.array([" ".join(x) for x in texts]))
    assert sum(k % 40 in got for k, got in enumerate(found)) >= 0.97 * 160


@pytest.mark.parametrize("kinds", [(1,), (0, 1, 2)])
@pytest.mark.parametrize("size", [7, 8, 10, 14, 25, 60])
def test_edited_items_at_the_end_and_as_the_whole(size, kinds):
    p = Planted(32)
    items = [p.words(size) for _ in range(40)]
    texts = []
    for k in range(160):
        texts += [p.words(30) + _edited(p, items[k % 40], kinds), _edited(p, items[k % 40], kinds)]
    found = c.Searcher(list(range(40)), [" ".join(x) for x in items]).search(pa.array([" ".join(x) for x in texts]))
    for got in (found[0::2], found[1::2]):
        assert sum(k % 40 in x for k, x in enumerate(got)) >= 0.97 * 160
    assert c.Searcher([1], [" ".join(items[0])]).search(pa.array([" ".join(items[0][:-1])])) == [{0: (1, 0)}]


def test_distance_is_exact():
    r, searcher = np.random.default_rng(3), c.Searcher([1], ["a b c d e f"])
    for _ in range(50):
        text = r.integers(0, 8, r.integers(1, 12))
        assert searcher.distance(0, text) == edit_distance(searcher.items[0].tolist(), text.tolist())


def test_walks_keep_near_sequences_near():
    """More edits, fewer equal samples; equal sequences always agree."""
    r, agree = np.random.default_rng(4), []
    for edits in (0, 1, 6):
        same = 0
        for k in range(300):
            words = r.integers(1, 1_000, 30)
            other = words.copy()
            other[r.choice(30, edits, replace=False)] = 0
            both = np.concatenate([words, other])
            steps = c.Searcher._steps(30, k + 1)
            keys = c._walk(both, np.array([0, 30]), 30, c.Searcher._bits(both, k + 1, 30), steps)
            same += keys[0] == keys[1]
        agree.append(same / 300)
    assert agree[0] == 1 and agree[1] > agree[2] > 0.02


def test_passes_agree(spark, monkeypatch):
    """One pass and several give the same rows, also where ids repeat or are missing."""
    p, items = _plan(20)
    rows = [(k, p.text(30) + " " + items[k % 20][1] + " " + items[(k + 7) % 20][1], None) for k in range(40)]
    rows += [(1, p.text(20), None), (1, rows[3][1], None), (None, p.text(9), None), (None, rows[5][1], "a"), (None, rows[5][1], "b"), (None, None, None)]
    columns = ("doc_id", "contaminated", "n_items", "items", "edits")
    one = table(c.contamination(documents(spark, rows), benchmark(spark, items)), *columns)
    clean = table(c.decontaminated(documents(spark, rows), benchmark(spark, items)), "doc_id", "text")
    assert len(one) == len(rows) and len(clean) == 3
    monkeypatch.setattr(c, "PASS_WORDS", 60)
    assert table(c.contamination(documents(spark, rows), benchmark(spark, items)), *columns) == one
    assert table(c.decontaminated(documents(spark, rows), benchmark(spark, items)), "doc_id", "text") == clean


def test_short_items_are_whole_texts():
    s = c.Searcher([7, 8, 9, 5], ["Yes, please.", "yes please", None or "", "one two three four"])
    texts = ["yes PLEASE!", "yes please do", "one two three four", "one two three four five", "", None]
    got = [sorted(s.item_ids[k] for k in x) for x in s.search(pa.array(texts))]
    assert got == [[7, 8], [], [5], [], [], []]


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "only four words here")], [(1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (None, "x y z v w")]])
def test_edges(spark, items):
    got = c.contamination(documents(spark), benchmark(spark, items)).collect()
    assert len(got) == len(ROWS)
    bad = {r["doc_id"]: r["items"] for r in got if r["contaminated"]}
    assert bad == ({1: [1, 2], 7: [1, 2]} if items and items[0][1] and "fox" in items[0][1] else {})
    assert c.contamination(empty(spark), benchmark(spark, items)).collect() == []
