"""Rows that every text operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

LONG = " ".join(f"word{k % 997} of line {k}" + (".\n" if k % 50 == 0 else "") for k in range(12_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n\x0b\x0c\r ", "b"),
    (5, LONG, "b"),
    (6, "Ünïcödé — “quotes” 日本語 texts, ñandú x.", "c"),
    (7, "The quick brown fox jumps over the lazy dog near the river bank.", None),
    (8, "same", "a"),
    (8, "same", "a"),
    (None, "no id here", "a"),
]
#: Names that results use too.
CLASH = "score double, n_words long, text_hash string, class_id long, taken long, kept boolean, h1 long, node long, mix_id long, label_id long, toxic_id long, leak_id long, near_copy_id long, key string, size long, html string, url string, block int"


def documents(spark, rows=ROWS, clash=True):
    extra = CLASH.count(",") + 1 if clash else 0
    schema = "doc_id long, text string, source string" + (f", {CLASH}" if clash else "")
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], schema)


def empty(spark):
    return documents(spark, [])


def table(df, *columns):
    return sorted(((tuple(r[c] for c in columns)) for r in df.collect()), key=str)


class Planted:
    """Words of a made-up language, the same for the same seed."""

    def __init__(self, seed):
        import random

        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice("bdfgklmnprst") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4))) for _ in range(3_000)]

    def words(self, n):
        return [self.r.choice(self.vocabulary) for _ in range(n)]

    def text(self, n):
        return " ".join(self.words(n))


pytest_plugins = ()
