"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import fresh_path
from millrace.llm.decontaminate import decontaminated
from millrace.llm.mixing import mix, mixed_documents
from millrace.llm.ngramjoin import keep_one
from millrace.llm.queries import tokenizer_path
from millrace.llm.tokenbin import digest, write_tokens
from millrace.llm.toxicity import without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Each row is judged by its own text; null, empty and wordless texts stay, and
    so do equal rows. An empty table, or one without labels, gives what it holds.
    """
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id's, null first, and one row of it.

    Null texts and texts without words are no copies and all stay; an empty table
    stays empty.
    """
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by its own text; null and empty texts stay, and so do equal
    rows. Without items all stay.
    """
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards.

    Texts without words are never taken; a null source is a source of its own;
    equal rows count one by one. An empty table gives an empty mix.
    """
    return mixed_documents(docs, mix(docs)[1])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and per document its place in them.

    Files follow the order in which the stage before wrote its rows, so the mix
    stays mixed; rows that no file holds follow their ids. Null and empty texts
    are the end id alone; equal rows are written one by one.
    """
    return digest(write_tokens(docs, tokenizer_path(), order=_written_order(docs)))


def _written_order(docs: DataFrame) -> list[Column] | None:
    """The number of the part file that a row lies in, and its place there; None if the rows don't come from files."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(file, row)
    except AnalysisException:
        return None
    return [F.regexp_extract(file, "^part-([0-9]+)", 1).try_cast("long"), file, row]


STAGES = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing", mixture),
    ("token files", tokens),
]

#: The model, the joins on word hashes and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
