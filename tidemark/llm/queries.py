"""The training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracle
from tidemark.llm.chat import op6_chat_formatting
from tidemark.llm.linedup import op5_line_dedup
from tidemark.llm.lm import op9_lm_scoring
from tidemark.llm.media import op10_media_columns
from tidemark.llm.mixing import op7_mixing
from tidemark.llm.ngramjoin import op3_ngram_jaccard_join
from tidemark.llm.packing import op8_packing
from tidemark.llm.phrases import op11_phrase_mining
from tidemark.llm.pieces import op13_piece_codec
from tidemark.llm.pii import op2_pii_surrogates
from tidemark.llm.quality import op4_quality_rules
from tidemark.llm.urlfilter import op1_url_filters
from tidemark.llm.whitening import op12_embedding_whitening

_QUERIES = [
    op1_url_filters, op2_pii_surrogates, op3_ngram_jaccard_join, op4_quality_rules, op5_line_dedup,
    op6_chat_formatting, op7_mixing, op8_packing, op9_lm_scoring, op10_media_columns, op11_phrase_mining,
    op12_embedding_whitening, op13_piece_codec,
]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
