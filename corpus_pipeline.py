"""The corpus pipeline: five stages, each calling one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import scratch, table
from tidemark.llm.linedup import drop_shared_lines
from tidemark.llm.mixing import MixParams, mix_documents
from tidemark.llm.ngramjoin import one_of_each
from tidemark.llm.packing import default_ranks, pack_documents
from tidemark.llm.quality import clean_documents


#: Target shares of the mix. The quality rules leave next to nothing of the domain ``poor``: it has no target.
WEIGHTS = {"good": 0.97, "toxic": 0.03}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, then documents that fail them.

    Null, empty and short texts go; long ones are judged whole; repeated rows are judged alike; a
    null id is kept. An empty table gives an empty one, columns of any name pass through.
    """
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by several documents stay in the one of the largest id.

    All rows stay, null text becomes empty; rows of one id are one document and are cut alike, a
    null id is below all others. An empty table gives an empty one, columns of any name pass through.
    """
    return drop_shared_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id.

    Null ids come after all others; repeated rows become one; rows without words stay, one for each
    id and text. An empty table gives an empty one, columns of any name pass through.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as their fitted rates say, none more than once.

    Rows of one id stay or go alike, null ids too; texts without words have no tokens and the rate
    of their posterior. An empty table gives an empty one, columns of any name pass through.
    """
    return mix_documents(docs, table(spark, sf_dir, "labels"), MixParams(weights=WEIGHTS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens.

    Null and empty texts are the end id alone; every row is packed, repeated ones and null ids
    too. An empty table gives no pieces, other columns are not carried.
    """
    return pack_documents(docs, default_ranks())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Hashed n-grams, a fitted classifier and the tokeniser's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
