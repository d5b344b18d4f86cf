"""Joins that a hot key does not gather in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may meet, at least; and keys with more rows than that, at most.
HOT_ROWS, HOT_KEYS = 256, 50_000


def null_safe_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the facts of their keys, absent keys equal to each other; rows without facts stay.

    ``facts`` has a row a key, and ``n`` counts the key's rows, ``total`` all rows
    at least. Fewer than ``HOT_KEYS`` keys hold more than ``total / HOT_KEYS`` rows
    each: their facts are broadcast, those of the other keys are shuffled.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    names = [f"on_{k}" for k in range(len(on))]
    facts = facts.select(*(F.col(c).alias(k) for c, k in zip(on, names, strict=True)), *(c for c in facts.columns if c not in on))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, names, strict=True)])
    tagged = rows.join(F.broadcast(facts.filter(F.col(n) > most).withColumn("is_hot", F.lit(True))), same, "left")
    hot = tagged.filter(F.col("is_hot").isNotNull()).drop("is_hot", *names)
    rest = tagged.filter(F.col("is_hot").isNull()).select(*rows.columns)
    return hot.unionByName(rest.join(facts.filter(F.col(n) <= most), same, "left").drop(*names))
