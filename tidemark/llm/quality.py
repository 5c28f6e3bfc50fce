"""Quality rules: line-first cleaning.

Every line is judged on its own (punctuation, symbols, navigation, boilerplate); failing lines
go, and a document that loses too large a share of its words, or fails the base rules, goes too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import attach, coded, mix64, numbered, segment_sums, table, texts_of, words_of


@dataclass(frozen=True)
class LineRules:
    """Parameters of the rules.

    min_words, max_repeat_pct: base rules. max_symbols_pct: symbol characters per 100 words of a
    line. max_bars_pct: separator words per 100 words of a line. max_lost_pct: words lost with
    failing lines per 100 words of the document. terminal: a line of at least min_line_words
    words has to end with one of these, closing quotes and brackets aside.
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbols_pct: int = 30
    max_bars_pct: int = 20
    max_lost_pct: int = 40
    min_line_words: int = 1
    terminal: str = ".!?…。！？।؟:;"
    boilerplate: str = (
        r"(?i)all rights reserved|licensed under the |released under the [a-z0-9 ]*license|"
        r"terms (of use|and conditions)|privacy policy|cookie policy|accept (all )?cookies|"
        r"javascript is (disabled|required)|lorem ipsum|subscribe to our newsletter|©|\(c\) (19|20)\d\d"
    )


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_lines", T.LongType()), T.StructField("n_bad_lines", T.LongType()), T.StructField("n_lost_words", T.LongType()),
    T.StructField("kept", T.BooleanType()),
]


def _strip_words(texts: pa.Array) -> pa.Array:
    """Texts without the six white-space characters of the word rule."""
    return pc.replace_substring_regex(texts, r"[ \t\n\v\f\r]+", "")


def _repeat_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words per text inside 3-word windows that the text holds at least twice."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = mix64(mix64(mix64(c[:-2]) + c[1:-1]) + c[2:]) + mix64(doc[:-2] + np.uint64(1 << 40))
    inside = doc[:-2] == doc[2:]
    order = np.sort(key[inside])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    at = np.searchsorted(twice, key)
    hit = inside & (twice[np.minimum(at, len(twice) - 1)] == key)
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return segment_sums(cover.astype(np.int64), counts)


def _judge(batch: pa.RecordBatch, rules: LineRules) -> tuple[list[pa.Array], pa.Array]:
    """The columns of FIELDS and the cleaned texts."""
    texts = texts_of(batch)
    n = len(texts)
    words, counts = words_of(texts)
    codes, _ = coded(words)
    chars = np.asarray(pc.utf8_length(_strip_words(texts))).astype(np.int64)
    symbols = np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>]")).astype(np.int64)
    repeats = _repeat_words(codes, counts)

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    per_doc = np.asarray(pc.list_value_length(split)).astype(np.int64)
    line_words, line_counts = words_of(lines)
    full = line_counts > 0
    line_codes, _ = coded(lines)
    owner = np.repeat(np.arange(n, dtype=np.int64), per_doc)
    # a line with a word is a repeat if its text stood earlier in the same document
    dup = np.zeros(len(lines), bool)
    if len(lines):
        key = owner * (int(line_codes.max()) + 1) + line_codes
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        dup = ~first & full
    n_dup = segment_sums(dup.astype(np.int64), per_doc)

    trimmed = pc.utf8_trim(lines, " \t\v\f\r\"'”’»)]}*_")
    tail = "[" + "".join("\\" + c if c in ".!?" else c for c in rules.terminal) + "]$"
    ends = np.asarray(pc.match_substring_regex(trimmed, tail)).astype(bool)
    line_symbols = np.asarray(pc.count_substring_regex(lines, r"[#*$%&|<>]")).astype(np.int64)
    bars = np.asarray(pc.match_substring_regex(line_words, r"^[|>»·•/\\-]+$")).astype(np.int64) if len(line_words) else np.zeros(0, np.int64)
    n_bars = segment_sums(bars, line_counts)
    boiler = np.asarray(pc.match_substring_regex(lines, rules.boilerplate)).astype(bool)
    bad = full & (
        ((line_counts >= rules.min_line_words) & ~ends)
        | (100 * line_symbols > rules.max_symbols_pct * line_counts)
        | (100 * n_bars > rules.max_bars_pct * line_counts)
        | boiler
    )
    lost = segment_sums(np.where(bad, line_counts, 0), per_doc)
    base_failed = (counts < rules.min_words) | (100 * repeats > rules.max_repeat_pct * counts)
    kept = ~base_failed & (100 * lost <= rules.max_lost_pct * counts)
    good = ~bad
    sizes = segment_sums(good.astype(np.int64), per_doc)
    survivors = lines.filter(pa.array(good))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    cleaned = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), survivors), pa.scalar("\n", pa.large_string()))
    long = lambda x: pa.array(x, pa.int64())
    return [
        long(counts), long(chars), long(symbols), long(n_dup), long(repeats), pa.array(base_failed),
        long(per_doc), long(segment_sums(bad.astype(np.int64), per_doc)), long(lost), pa.array(kept),
    ], cleaned


def judge_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), cleaned_col: str | None = None) -> DataFrame:
    """All rows of ``docs`` with the columns of FIELDS and, if asked for, the cleaned text.

    Null text counts as empty: no words, base_failed true, kept false. Empty tables give empty
    tables, repeated rows are judged alike, input columns named like a computed one are replaced.
    """
    fields = FIELDS + ([T.StructField(cleaned_col, T.StringType())] if cleaned_col else [])

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        made, cleaned = _judge(batch, rules)
        return [*made, cleaned.cast(pa.string())] if cleaned_col else made

    return attach(docs, text_col, columns, fields)


def clean_documents(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents with their cleaned text, in the input's columns; ``n_chars``, if there, follows the text.

    Null and empty texts are not kept, nor are texts of any length that fail the rules; rows with
    a null id and repeated rows are judged like others. Columns of any name pass through.
    """
    plain = numbered(docs)
    judged = judge_lines(plain, f"c{docs.columns.index(text_col)}", rules, "cleaned").filter("kept")
    made = {text_col: F.col("cleaned"), "n_chars": F.length("cleaned")}
    return judged.select(*[made.get(c, F.col(x)).cast(docs.schema[c].dataType).alias(c) for c, x in zip(docs.columns, plain.columns, strict=True)])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_lines(docs).select("doc_id", *[f.name for f in FIELDS])
