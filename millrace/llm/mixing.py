"""Mixing sources to target weights through a hypergeometric splitting tree.

Every source owes the mix a target number of words, at most ``MOST`` times its
size. Its documents are put in a keyed random order and cut into blocks of about
equally many words, and the blocks are permuted. Whole passes take all blocks;
the last pass takes, from the permuted list, as many as the words still owed
fill, the last of them up to the document at which the target falls. The numbers
of blocks that the sources owe form the root of a binary tree; each node parts a
uniformly drawn half of its blocks to the left and the others to the right, so
that every child's counts follow the multivariate hypergeometric law and all
counts stay exact. A leaf is an output shard: it takes, for each source, as many
blocks of the source's permuted list as its quota says, disjoint from all
others', and shuffles their documents. What the mix takes of a document is read
from the shards.

Only DataFrame functions are used. Texts are read once, for their sizes, and
only ids and sizes are shuffled. Shards, blocks and stripes grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Output shards at least, and words in one at most, about.
SHARDS, SHARD_WORDS = 16, 1 << 26
#: Blocks in a shard, about.
BLOCKS = 64
#: Salts by which the keyed order of a source is dealt to tasks, at least, and rows for one, about.
STRIPES, STRIPE_ROWS = 256, 50_000
#: Rounds in which small documents fill what a source still owes.
ROUNDS = 2


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null that is equal where sources are."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def identified(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with (mix_id, mix_text, mix_nth), which tells all rows apart, equal ones too; sources order repeated ones, as in ``mix``."""
    keyed = docs.withColumn("mix_id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn("mix_text", F.xxhash64(F.col(text_col)))
    return keyed.withColumn("mix_nth", F.row_number().over(W.partitionBy("mix_id", "mix_text").orderBy(source_key(F.col(source_col).cast("string")))))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source_key, source, source_size) with each source's target.

    Shares by weight stop at ``most`` times the source's size and the excess goes
    to the others by weight. The end of that process is the level L with
    sum(min(weight * L, most * size)) = share * total, found from running sums in
    the order of most * size / weight. One row a source is handled here.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    rows = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "rank")
    below, here_on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(here_on))
    rows = rows.withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole), F.max("full_at").over(whole)))
    return rows.select("source_key", "source", "rank", "weight", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def _running(rows: DataFrame, name: str, counts: Column) -> DataFrame:
    """``rows`` with the words that lie before each one, where ``counts``, in its source's keyed order.

    A source is dealt to stripes by its keys: running sums inside a stripe, plus
    the sizes of the stripes before, give places without gathering a source in
    one task.
    """
    at, size = ["source_key", "stripe"], F.when(counts, F.col("size")).otherwise(0)
    inside = F.sum(size).over(W.partitionBy(*at).orderBy("key", "mix_id", "mix_text", "mix_nth").rowsBetween(W.unboundedPreceding, -1))
    stripes = rows.groupBy(*at).agg(F.sum(size).alias("n"))
    before = F.sum("n").over(W.partitionBy("source_key").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1))
    stripes = stripes.select(*at, F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(stripes, at).withColumn(name, F.col("before") + F.col("inside")).drop("before", "inside")


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of their sources, joined stripe by stripe so that no source meets in one task."""
    at = ["source_key", "stripe"]
    spread = rows.select(*at).distinct().join(facts, "source_key")
    return rows.join(spread, at)


def _ordered(sized: DataFrame, goal: DataFrame, seed: str, block_words: int, stripes: int) -> DataFrame:
    """Each row's block in its source's order, and how often the mix takes it.

    ``whole`` passes take every row; ``extra`` marks those that the last, partial
    pass takes: the rows of the permuted blocks up to the words owed, then, in
    further rounds and as part of the last block (``tail``), rows small enough for
    the words still owed, so that the last row taken is small.
    """
    key = F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("mix_text"), F.col("mix_nth"))
    keyed = sized.withColumn("key", key).withColumn("stripe", F.pmod(F.col("key"), F.lit(stripes))).drop("source")
    rows = _running(_with_facts(keyed, goal), "place", F.lit(True))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = stored(rows.withColumn("block", F.expr(f"place div {block_words}")), "places")
    blocks = rows.groupBy("rank", "block").agg(F.min("place").alias("first"), F.sum("size").alias("words"), F.max("owed").alias("owed"), F.max("source_key").alias("source_key"))
    permuted = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(f"{seed}/turns"), "rank", "block"), "block")  # a bounded number of blocks
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(blocks.withColumn("before", before), "turns")
    tails = blocks.filter("before < owed and words > 0").groupBy("source_key").agg(F.max_by("block", "before").alias("tail"))
    tails = goal.select("source_key").join(tails, "source_key", "left")
    rows = _with_facts(rows, tails).join(blocks.select("rank", "block", "first", "before"), ["rank", "block"])
    upto = F.col("before") + F.col("place") - F.col("first") + F.col("size")
    rows = rows.withColumn("extra", (F.col("size") > 0) & (upto <= F.col("owed"))).withColumn("last_block", F.col("block"))
    rows = stored(rows.drop("first", "before"), "places")
    for k in range(ROUNDS):
        gone = rows.groupBy("source_key").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("gone"))
        rows = _with_facts(rows, gone).withColumn("gap", F.col("owed") - F.col("gone"))
        small = ~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
        rows = _running(rows.withColumn("small", small), "next", F.col("small"))
        part = F.col("size") / 2 if k == ROUNDS - 1 else F.col("size")
        more = F.col("small") & (F.col("next") + part <= F.col("gap"))
        rows = rows.withColumn("last_block", F.when(more, F.col("tail")).otherwise(F.col("last_block"))).withColumn("extra", F.col("extra") | more)
        rows = stored(rows.drop("gone", "gap", "small", "next"), "places")
    return rows.select("mix_id", "mix_text", "mix_nth", "source", "size", "rank", "source_size", "target", "block", "last_block", "whole", "extra")


def _takes(ordered: DataFrame) -> DataFrame:
    """One row for each time that the mix takes a document, with its pass and block."""
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("int")).otherwise(0)
    passes = F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), times)
    block = F.when(F.col("pass") == F.col("whole"), F.col("last_block")).otherwise(F.col("block"))
    return ordered.withColumn("pass", F.explode(passes)).withColumn("block", block).drop("last_block")


def split_tree(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """(rank, shard, quota): the leaves' exact quotas of the sources' ``quota`` blocks.

    A node's left child gets half of its blocks, drawn without replacement and
    with equal chances; the blocks have no names here, only their source counts.
    """
    tokens = quotas.select("rank", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("token")).withColumn("node", F.lit(0))
    for level in range(levels):
        draw = F.xxhash64(F.lit(f"{seed}/{level}"), F.col("rank"), F.col("token"))
        of_node = W.partitionBy("node")
        at = F.row_number().over(of_node.orderBy(draw, "rank", "token"))
        tokens = tokens.select("rank", "token", (F.col("node") * 2 + (at * 2 > F.count("*").over(of_node) + 1).cast("int")).alias("node"))
    return tokens.groupBy("rank", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The sizes and targets of all rows, and the mix's rows.

    First: a row for each row of ``docs``, by (mix_id, mix_text, mix_nth): its
    source, size, source_size and target. Second: these with pass, block, shard
    and position, one row for each time that a row is taken. A null source is
    the last source; a null id counts as the smallest long; null texts have size
    0 and are never taken; an empty table gives empty results; further columns
    are not looked at. The same rows and seed give the same mix. The number of
    shards, a power of two, follows from the words unless it is given.
    """
    if shards is not None and shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    source = F.col(source_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), source_key(source).alias("source_key"), source.alias("source"), n_words(F.col(text_col)).alias("size"), F.col(text_col).alias("text"))
    hashed = named.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("mix_id"), F.xxhash64("text").alias("mix_text"), "source_key", "source", "size")
    sized = stored(hashed.withColumn("mix_nth", F.row_number().over(W.partitionBy("mix_id", "mix_text").orderBy("source_key"))), "sizes")
    goal = targets(sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")))
    n_rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(SHARDS, 1 << (int(words * SHARE) // SHARD_WORDS).bit_length())
    ordered = _ordered(sized, goal, seed, max(1, words // (shards * BLOCKS)), max(STRIPES, n_rows // STRIPE_ROWS))
    taken = _takes(ordered)
    blocks = stored(taken.groupBy("rank", "pass", "block").agg(F.count("*").alias("n")), "blocks")
    quotas = blocks.groupBy("rank").agg(F.count("*").alias("quota"))
    leaves = split_tree(quotas, shards.bit_length() - 1, seed)
    upto = F.sum("quota").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    runs = leaves.withColumn("first", F.coalesce(upto, F.lit(0)) + 1)
    dealt = runs.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("turn"))
    permuted = blocks.withColumn("turn", F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(f"{seed}/blocks"), "rank", "pass", "block"), "pass", "block")).cast("long"))
    placed = permuted.join(dealt, ["rank", "turn"]).select("rank", "pass", "block", "shard")
    mixed = taken.join(placed, ["rank", "pass", "block"])
    position = F.xxhash64(F.lit(f"{seed}/shuffle"), "mix_id", "mix_text", "mix_nth", "pass")
    return ordered, mixed.withColumn("position", position)


def taken_words(ordered: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per row of the input: doc_id, size, source_size, target, taken."""
    row = ["mix_id", "mix_text", "mix_nth"]
    gone = mixed.groupBy(*row).agg(F.sum("size").alias("taken"), F.collect_list("shard").alias("shards"))
    doc_id = F.when(F.col("mix_id") != F.lit(-(2**63)), F.col("mix_id")).alias("doc_id")
    return ordered.join(gone, row, "left").select(doc_id, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "shards")


def mixed_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, in the order of (shard, position)."""
    row = ["mix_id", "mix_text", "mix_nth"]
    own = docs.select(F.struct("*").alias("mix_row"), F.col(id_col).alias("mix_doc"), F.col(text_col).alias("mix_body"), F.col(source_col).alias("mix_source"))
    found = identified(own, "mix_doc", "mix_body", "mix_source").join(mixed.select(*row, "shard", "position"), row)
    dealt = found.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")
    return dealt.select("mix_row.*")
