import re
from collections import Counter

import pytest
from edge import LONG, ROWS, Planted, documents, empty
from millrace.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    return {k + j for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for j in range(n)}


def by_hand(text):
    words, lines, again, chars = WORD.findall(text or ""), set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in lines:
                again, chars = again + 1, chars + sum(map(len, WORD.findall(line)))
            lines.add(line)
    total = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": again, "n_repeat_words": len(covered(words, 3)), "dup_line_share": chars / max(total, 1)}
    for n in q.COVERAGE:
        out[f"dup_{n}gram_share"] = sum(len(words[k]) for k in covered(words, n)) / max(total, 1)
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not out["base_failed"] and out["dup_line_share"] <= q.LINE_COVERAGE and all(out[f"dup_{n}gram_share"] <= s for n, s in q.COVERAGE.items())
    return out


def _texts():
    p = Planted(4)
    clean, line = p.text(120), p.text(12)
    return [clean, clean + "\n" + clean, "\n".join([p.text(60)] + [line] * 9), " ".join([p.text(6)] * 30), "x " * 200, clean + " ###", p.text(49), LONG, *(r[1] for r in ROWS)]


def test_against_brute_force(spark):
    texts = _texts()
    df = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r.asDict() for r in q.quality_rules(df).collect()}
    for k, text in enumerate(texts):
        for name, value in by_hand(text).items():
            assert got[k][name] == pytest.approx(value), (k, name)
    assert got[0]["kept"] and not any(got[k]["kept"] for k in (1, 2, 3, 4, 6))


def test_edges(spark):
    assert q.quality_rules(documents(spark)).count() == len(ROWS)
    assert q.quality_rules(empty(spark)).collect() == []
