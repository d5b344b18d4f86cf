import re
from collections import Counter, defaultdict

import pytest
from edge import ROWS, Planted, documents, empty, table
from millrace.llm import mixing as m
from pyspark.sql import functions as F


def goals(sizes, share=1.5, most=2.0):
    """Targets by sharing out and taking back what is above the caps, again and again."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target | {s: weight[s] * level for s in free}


def _rows():
    p = Planted(5)
    sources = ["hot"] * 200 + [f"s{k % 9}" for k in range(270)] + [None] * 40 + ["Ä"] * 20 + ["tiny"]
    return [(k, p.text(p.r.choice([0, 3, 20, 60, 200]) if s != "tiny" else 7), s) for k, s in enumerate(sources)]


def test_targets_and_takes(spark):
    rows = _rows()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    want, source = goals(sizes), {i: s for i, _, s in rows}
    got = m.taken_words(*m.mix(documents(spark, rows))).collect()
    taken = defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(10, 0.01 * want[s]), s
    again = m.taken_words(*m.mix(documents(spark, rows).repartition(7))).collect()
    assert table_of(again) == table_of(got)


def table_of(rows):
    return sorted((r["doc_id"], r["taken"]) for r in rows)


def test_blocks_are_dealt_once_and_shards_are_even(spark):
    ordered, mixed = m.mix(documents(spark, _rows()))
    rows = mixed.collect()
    assert len({(r["mix_id"], r["mix_text"], r["mix_nth"], r["pass"]) for r in rows}) == len(rows)
    place = defaultdict(set)
    for r in rows:
        place[r["rank"], r["pass"], r["block"]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    blocks = Counter(next(iter(s)) for s in place.values())
    assert sorted(blocks) == list(range(m.SHARDS)) and max(blocks.values()) - min(blocks.values()) <= 1


def test_drawn_blocks_decide_what_is_taken(spark):
    """Blocks are taken whole, but for one of each source; the shards follow the input's size."""
    ordered, mixed = m.mix(documents(spark, _rows()))
    rows, all_rows, last = mixed.collect(), ordered.collect(), defaultdict(int)
    held = Counter((r["rank"], r["block"]) for r in all_rows if r["size"])
    taken = Counter((r["rank"], r["block"]) for r in rows if r["pass"] == r["whole"])
    for (rank, _block), n in taken.items():
        last[rank] += n != held[rank, _block]
    assert taken and all(n <= 1 for n in last.values())
    again = Counter(r["shard"] for r in m.mix(documents(spark, _rows()), shards=4)[1].collect())
    assert sorted(again) == [0, 1, 2, 3]


def test_the_tree_is_hypergeometric(spark):
    """The left half of 8 + 4 blocks holds 4 of the first source's on average, with the law's variance."""
    quotas = spark.createDataFrame([(0, 8), (1, 4)], "rank int, quota int")
    left = []
    for k in range(60):
        leaves = m.split_tree(quotas, 1, f"seed{k}").collect()
        by = {(r["rank"], r["shard"]): r["quota"] for r in leaves}
        assert by.get((0, 0), 0) + by.get((1, 0), 0) == 6 and sum(by.values()) == 12
        left.append(by.get((0, 0), 0))
    mean = sum(left) / len(left)
    variance = sum((x - mean) ** 2 for x in left) / len(left)
    assert abs(mean - 4) < 0.5 and 0.4 < variance < 1.6  # the law: mean 4, variance 0.97


def test_mixed_documents(spark):
    docs = documents(spark, _rows() + [(900, "same text here", "s1")] * 3)
    ordered, mixed = m.mix(docs)
    out = m.mixed_documents(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in m.taken_words(ordered, mixed).collect():
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_edges(spark):
    got = m.taken_words(*m.mix(documents(spark)))
    assert got.count() == len(ROWS)
    assert [r["taken"] for r in got.filter("doc_id in (2, 3, 4)").collect()] == [0, 0, 0]
    assert m.taken_words(*m.mix(empty(spark))).collect() == []
    assert table(m.mixed_documents(empty(spark), m.mix(empty(spark))[1]), "doc_id") == []
    with pytest.raises(ValueError, match="power"):
        m.mix(empty(spark), shards=3)


def test_repeated_rows_of_several_sources_keep_their_own_counts(spark):
    """A row that another source repeats is taken as often as its own source says."""
    rows = [(k, f"word {k} " * 5, s) for k in range(40) for s in ("b", "a")] + [(100 + k, "long text " * 40, "c") for k in range(20)]
    docs = documents(spark, rows)
    ordered, mixed = m.mix(docs)
    told = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    drawn = {r.source: r.n for r in m.mixed_documents(docs, mixed).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert told == drawn
