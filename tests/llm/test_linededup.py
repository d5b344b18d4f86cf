import hashlib
from collections import defaultdict

import numpy as np
from edge import ROWS, Planted, documents, empty, table
from millrace.llm import common
from millrace.llm import linededup as d

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def by_hand(rows):
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    last = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def _rows():
    p = Planted(2)
    common, umlaut = "A line that MANY documents share, é", "ÄÖÜ line of some twenty points"
    rows = [(k, "\n".join([p.text(8), f"  {common}\t" if k % 2 else common.upper().replace("É", "é"), umlaut if k % 9 == 0 else p.text(4), "short", "x" * 20 if k < 3 else "y" * 19]), None) for k in range(60)]
    return rows + [(100, common + "\n" + common, None), (101, None, None), (102, "", None), (103, "\n\n", None), (104, "  " + "x" * 20 + "  \n\nend", None)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "GROUP_PROBES", 20)  # many probing groups, copied shards
    rows = _rows()
    assert table(d.dedup_lines(documents(spark, rows)), "doc_id", "text", "n_lines", "n_dropped") == by_hand(rows)
    digest = {r["doc_id"]: r["kept_sha256"] for r in d.digest(d.dedup_lines(documents(spark, rows))).collect()}
    assert digest == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in by_hand(rows)}


def test_rows_that_share_an_id_lose_their_own_lines(spark, monkeypatch):
    """Repeated and missing ids count as one document each, and keep a row for each of theirs."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    line, other = "this line is found in many documents", "another line that several documents hold"
    rows = [(1, f"{line}\nx", None), (2, line, None), (2, f"{line}\n{other}", None), (2, line, None), (3, f"a\n{line}", None), (5, other, None), (6, other, None)]
    assert table(d.dedup_lines(documents(spark, rows)), "doc_id", "text", "n_lines", "n_dropped") == by_hand(rows)
    none = [(None, f"{line}\nrow {k % 7}", None) for k in range(50)] + [(1, line, None), (2, line, None)]
    want = [(-(2**63), f"row {k % 7}", 2, 1) for k in range(50)] + [(1, "", 1, 1), (2, line, 1, 0)]
    assert table(d.dedup_lines(documents(spark, none)), "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=str)
    two = [(None, line, None)] * 9 + [(4, line, None)]  # two documents are too few
    assert d.dedup_lines(documents(spark, two)).filter("n_dropped > 0").count() == 0


def test_edges(spark):
    got = table(d.dedup_lines(documents(spark)), "doc_id", "n_lines", "n_dropped")
    assert len(got) == len(ROWS) and (2, 1, 0) in got and (3, 1, 0) in got and (-(2**63), 1, 0) in got
    assert d.dedup_lines(empty(spark)).collect() == []


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1_000, 20_000):
        r = np.random.default_rng(n)
        h1, h2 = np.unique(r.integers(0, 2**63, n, dtype=np.uint64)), r.integers(0, 2**63, n, dtype=np.uint64)[: n]
        h2 = h2[: len(h1)]
        if n > 2:
            h1[1] = h1[0]  # told apart by the other half
        levels, place = d.build_levels(h1, h2)
        assert sorted(place.tolist()) == list(range(len(h1)))
        assert np.array_equal(d.look_up(levels, h1, h2), place)
        bits = b"".join(np.packbits(x).tobytes() for x in levels)
        assert all(np.array_equal(a, b) for a, b in zip(levels, d._unpack_levels([len(x) for x in levels], bits), strict=True))
