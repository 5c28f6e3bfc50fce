"""Phrase collocation mining.

Texts are exploded into n-grams of 1 to ``max_words`` words, which are aggregated per language.
The levels are exploded in turn: single words, pairs of frequent words, then all longer n-grams
of frequent pairs. An n-gram with a rare part is rare itself, so nothing that counts is left out.
Counts of both parts of every cut are joined on, scores are exact decimals, an anti-join with
one-word extensions drops what only occurs inside something longer, and a window ranks the rest.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import coded, discard, mix64, release, slices, stored, table, texts_of


@dataclass(frozen=True)
class PhraseParams:
    """least: occurrences that a phrase needs. max_words: words of the longest phrase. top: phrases of each
    language. scale: factor of the score before flooring. slice_bytes: text exploded at a time. flag_bits,
    most_flag_bits: bounds of the size of the bit map of frequent n-grams, as powers of two (sixteen bits for
    each between them); it only decides what is exploded further, and false hits are harmless. salts: parts
    of a language that are ranked on their own first."""

    least: int = 100
    max_words: int = 5
    top: int = 2000
    scale: int = 1000
    slice_bytes: int = 4 << 20
    flag_bits: int = 16
    most_flag_bits: int = 27
    salts: int = 64


#: Up to so many languages' totals are broadcast.
MANY_LANGUAGES = 10_000
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANKS = _BREAKS.copy()
_BLANKS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order with A-Z lower-cased, the text that each is of, and the number of the piece it is in."""
    raw = texts.cast(pa.large_binary())
    starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if not len(raw) or starts[-1] == starts[0]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = _LOWER[np.frombuffer(raw.buffers()[2], np.uint8)[starts[0] : starts[-1]]]
    blank = _BLANKS[flat]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = starts[1:-1] - starts[0]
    inner = inner[inner < len(flat)]
    first[inner] = ~blank[inner]  # a text's first word ends the one before it
    at = np.nonzero(first)[0]
    text = np.searchsorted(starts[1:] - starts[0], at, side="right")
    pieces = np.cumsum(_BREAKS[flat])[at] + text
    kept = ~blank
    ends = np.concatenate([np.cumsum(kept)[at] - 1, [int(kept.sum())]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat[kept].tobytes()))
    return words, text, pieces


def _hash(words: pa.Array, langs: list[str]) -> np.ndarray:
    """A 64-bit hash for each language and distinct word."""
    plain = np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    return np.concatenate([mix64(plain + (np.uint64(zlib.crc32(x.encode())) << np.uint64(32))) for x in langs]) if langs else plain


def _extended(key: np.ndarray, by: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key * np.uint64(31) + by)


def _hit(flags: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(32 * len(flags) - 1)).astype(np.int64)
    return (flags[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def _exploded(batch: pa.RecordBatch, sizes: tuple[int, ...], flags: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of some sizes in a slice of rows, with their counts.

    flags: bit map of frequent words where pairs are asked for, of frequent pairs for longer
    n-grams; those with a part that isn't in the map are left out.
    """
    langs, names = coded(batch.column("lang"))
    names = names.to_pylist()
    words, text, piece = piece_words(texts_of(batch))
    if not len(words):
        return
    plain, distinct = coded(words)
    code = plain + len(distinct) * langs[text]
    word_hash = _hash(distinct, names) if flags is not None else None

    def counted(n: int, starts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Rows for the n-grams that begin at ``starts``, told apart by ``ids``."""
        _, first, count = np.unique(ids, return_index=True, return_counts=True)
        at = starts[first]
        parts = [distinct.take(pa.array(plain[at + k])) for k in range(n)]
        phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        lang = pa.array(names, pa.string()).take(pa.array(langs[text[at]]))
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(at), n, np.int32)), phrase.cast(pa.string()), pa.array(count)], names=GRAMS.names)

    if 1 in sizes:
        yield counted(1, np.arange(len(code)), code)
        total = np.bincount(langs[text], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names), pa.string()), pa.array(total)], names=GRAMS.names)
    if max(sizes) < 2:
        return
    joined = piece[1:] == piece[:-1]  # whether the next word is in the same piece
    if 2 in sizes:
        fine = _hit(flags, word_hash)[code]
        good = joined & fine[1:] & fine[:-1]
    else:
        good = joined
        good[good] = _hit(flags, _extended(word_hash[code[:-1][good]], word_hash[code[1:][good]]))
    starts = np.nonzero(good)[0]
    ids = code[starts] * (len(distinct) * len(names)) + code[starts + 1]
    for n in range(2, max(sizes) + 1):
        if n in sizes:
            if not len(starts):
                return
            yield counted(n, starts, ids)
        if n < max(sizes):  # those whose last pair is good go on; ids are made dense again so that they never overflow
            goes = (starts + n < len(code)) & good[np.minimum(starts + n - 1, len(good) - 1)]
            starts = starts[goes]
            _, ids = np.unique(ids[goes], return_inverse=True)
            ids = ids * (len(distinct) * len(names)) + code[starts + n]


def explode_grams(docs: DataFrame, sizes: tuple[int, ...], params: PhraseParams, flags: np.ndarray | None = None) -> DataFrame:
    """``(lang, words, phrase, f)`` rows of ``(lang, __text)``, counted per slice of text; size 0 counts all words."""
    sent = docs.sparkSession.sparkContext.broadcast(flags)  # 2^most_flag_bits bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "__text", params.slice_bytes):
                yield from _exploded(part, sizes, sent.value)
        release()

    return docs.mapInArrow(run, GRAMS)


def count_grams(docs: DataFrame, sizes: tuple[int, ...], params: PhraseParams, flags: np.ndarray | None = None) -> DataFrame:
    """N-grams of some sizes that occur ``least`` times or more, and the number of words (size 0) of each language."""
    total = explode_grams(docs, sizes, params, flags).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return total.filter((F.col("words") == 0) | (F.col("f") >= params.least))


def flagged(grams: DataFrame, params: PhraseParams) -> np.ndarray:
    """The bit map of words or pairs, in words of 32 bits: 2^most_flag_bits bits at most, whatever the input."""
    bits = min(params.most_flag_bits, max(params.flag_bits, int(16 * grams.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(0, np.uint64)
            if batch.num_rows:
                langs, names = coded(batch.column("lang"))
                split = pc.split_pattern(batch.column("phrase"), " ")
                words, distinct = coded(split.flatten())
                sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
                hashes = _hash(distinct, names.to_pylist())[words + len(distinct) * np.repeat(langs, sizes)]
                key = hashes[np.cumsum(sizes) - sizes]
                two = np.nonzero(sizes == 2)[0]
                key[two] = _extended(key[two], hashes[(np.cumsum(sizes) - 1)[two]])
            at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["w", "v"])

    made = grams.select("lang", "phrase").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[np.asarray(made["w"]).astype(np.int64)] = np.asarray(made["v"]).astype(np.uint32)
    return out


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("parts", first, length), " ")


def score_cuts(grams: DataFrame, params: PhraseParams) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score)``: every candidate with the counts of its lowest-scoring cut, the first on ties.

    Both parts of a cut occur at least as often as the whole, so their counts are there.
    """
    number = lambda c: F.col(c).cast("decimal(19,0)")
    counts = grams.filter("words > 0").select("lang", "phrase", "f")
    whole = grams.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("prefix"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("suffix"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("prefix"), F.col("f").alias("l")), ["lang", "prefix"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("r")), ["lang", "suffix"])
    totals = grams.filter("words = 0").select("lang", F.col("f").alias("n"))  # one row for each language
    if totals.limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES:
        totals = F.broadcast(totals)  # a join would put a language into one task
    cuts = cuts.join(totals, "lang").withColumns({"__a": number("a"), "__n": number("n"), "__l": number("l"), "__r": number("r")})
    # at most 38 digits: the counts of 10^16 words and the scale fit
    cuts = cuts.withColumn("score", F.expr(f"(cast(__a * __n as decimal(34,0)) * {params.scale}BD) div cast(__l * __r as decimal(38,0))"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best.alias("b")).select("lang", "phrase", "words", "a", "b.*")


def not_inside_longer(scored: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates that no phrase one word longer contains each time they occur.

    A longer phrase never occurs more often than what it contains: if one of several more words
    occurs as often, so does one of a single word more.
    """
    longer = grams.filter("words > 2").select("lang", "f", "words", F.split("phrase", " ").alias("parts"))
    inside = longer.select("lang", F.col("f").alias("a"), F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    return scored.join(inside, ["lang", "phrase", "a"], "left_anti")


def rank_phrases(phrases: DataFrame, params: PhraseParams) -> DataFrame:
    """The first ``top`` phrases of each language, ranked from 1. Parts of a language are ranked first, so no task sorts it whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", "__salt").orderBy(*order)
    salted = phrases.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(params.salts)))
    first = salted.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= params.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= params.top).drop("__salt")


def mine_phrases(docs: DataFrame, params: PhraseParams = PhraseParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score, words)`` of each language's best phrases.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each time.
    An empty table, or one without frequent phrases, gives no rows. Only the two named columns are
    read, so others may have any name. Long texts are exploded whole, one at a time. Rows of equal
    score are ordered by count, then by the bytes of the phrase.
    """
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    singles = stored(count_grams(source, (1,), params), "phrase-words")
    tables, flags = [singles], flagged(singles.filter("words = 1"), params)
    if params.max_words > 1:
        pairs = stored(count_grams(source, (2,), params, flags), "phrase-pairs")
        tables.append(pairs)
        if params.max_words > 2:
            tables.append(stored(count_grams(source, tuple(range(3, params.max_words + 1)), params, flagged(pairs, params)), "phrase-longer"))
    grams = functools.reduce(DataFrame.unionAll, tables)
    best = stored(rank_phrases(not_inside_longer(score_cuts(grams, params), grams), params), "phrase-ranked")
    discard(*tables)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two to five words of each language of all documents."""
    return mine_phrases(table(spark, sf_dir, "documents"))
