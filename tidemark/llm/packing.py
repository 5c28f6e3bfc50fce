"""Order-preserving packing into windows of at most 1,024 tokens.

Documents keep their order by id. The token stream of a block is cut where documents or
sentences end; dynamic programming minimises padding plus a penalty for every cut inside a
document, with a monotone queue for the padded windows and direct transitions for windows whose
length is a power of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import coded, segment_sums, slices, table, texts_of


@dataclass(frozen=True)
class PackParams:
    """window: most tokens of a sequence. sentence_cut, forced_cut: penalties, in padding tokens,
    of a cut at a sentence's end and of one inside a sentence longer than a window. block_tokens:
    tokens packed together; each block ends a sequence. cache_words: words whose ids a worker keeps.
    special: ids of strings that are one token wherever a text holds them."""

    window: int = 1024
    sentence_cut: float = 6.0
    forced_cut: float = 64.0
    block_tokens: int = 1_000_000
    cache_words: int = 200_000
    end_id: int = 0
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)


#: White space that a worker's word cache can't split at: any but single blanks and line breaks.
_ODD = re.compile(r"[^\S \n]|\s\s|\x00")


class Tokens:
    """Ids of the public byte-level vocabulary, as its ranks file gives them.

    Words (with the blank before them) are tokenised one by one and kept: the vocabulary's
    pattern never joins text across a blank or line break that stands alone. Texts with other
    white space are tokenised whole. Special strings are cut out of a text before its words are.
    """

    def __init__(self, ranks_path: str, limit: int, special: tuple[tuple[str, int], ...]):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith((b".", b"!", b"?", b"\n", "…".encode(), "。".encode()))
        self.special = [text for text, _ in special]
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def _ids(self, text: str) -> bytes:
        held = any(x in text for x in self.special)  # the plain call is faster
        return np.array(self.encoding.encode(text, allowed_special="all") if held else self.encoding.encode_ordinary(text), np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        as_str = texts.to_pylist()
        odd = np.array([bool(_ODD.search(t)) for t in as_str], bool)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
        split = pc.split_pattern(marked, "\x00")
        n_words = np.asarray(pc.list_value_length(split)).astype(np.int64)
        codes, distinct = coded(split.flatten())
        if len(self.cache) > self.limit:
            self.cache.clear()
        cache, found = self.cache, []
        for w in distinct.to_pylist():
            ids = cache.get(w)
            if ids is None:
                ids = cache[w] = self._ids(w)
            found.append(ids)
        flat = np.frombuffer(b"".join(found), np.uint32)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lens) - lens
        per_word = lens[codes]
        out = np.repeat(starts[codes] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())
        ids, counts = flat[out], segment_sums(per_word, n_words)
        if odd.any():
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.nonzero(odd)[0]:
                pieces[k] = np.frombuffer(self._ids(as_str[k]), np.uint32)
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, counts


_TOKENS: dict[tuple, Tokens] = {}


def tokens(*key) -> Tokens:
    """One tokeniser for each worker process."""
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(*key)
    return _TOKENS[key]


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """The cheapest way to cut at positions among ``cuts`` (ascending, the last is the end).

    Neighbouring cuts, and the first one and 0, are at most ``window`` apart. Returns the chosen positions, end included.
    """
    pos = np.concatenate([[0], cuts]).astype(np.int64)
    n = len(pos)
    pen = np.concatenate([[0.0], penalty])
    pen[-1] = 0.0
    exact: dict[int, list[int]] = {}
    size = window // 2
    while size >= 64:
        at = np.searchsorted(pos, pos - size)
        for j in np.nonzero((pos >= size) & (pos[at] == pos - size))[0]:
            exact.setdefault(int(j), []).append(int(at[j]))
        size //= 2
    where, fine = pos.tolist(), pen.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        p = where[j]
        while where[queue[0][1]] < p - window:
            queue.popleft()
        best, i = queue[0]
        best += window - p
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += fine[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chosen, j = [], n - 1
    while j:
        chosen.append(where[j])
        j = back[j]
    return np.array(chosen[::-1], np.int64)


def _candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Where a block may be cut, and the penalty of each cut."""
    sentence = np.nonzero(ends[np.minimum(ids, len(ends) - 1)])[0] + 1
    pos = np.union1d(sentence, doc_ends)
    gaps = np.diff(np.concatenate([[0], pos]))
    wide = np.nonzero(gaps > p.window)[0]
    forced = [np.arange(start + p.window // 4, pos[k], p.window // 4) for k in wide for start in [pos[k - 1] if k else 0]]
    extra = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    full = np.union1d(pos, extra)
    penalty = np.full(len(full), p.sentence_cut)
    penalty[np.searchsorted(full, extra)] = p.forced_cut
    penalty[np.searchsorted(full, doc_ends)] = 0.0
    return full, penalty


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def pack_documents(docs: DataFrame, ranks_path: str, text_col: str = "text", params: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, in the columns of SCHEMA (and ``ids``, if asked for).

    Null or empty text is the end id alone; a null id is carried. Documents are ordered by id
    (null first), rows of one id by a digest of their text; every row is packed, repeated ones too.
    Other columns are not carried. A document longer than a
    window runs over several sequences. Sequence ids are unique: the partition's number times
    2^40 plus a count.
    """
    spark = docs.sparkSession
    schema = T.StructType([*SCHEMA.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else SCHEMA
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    # rows of one id (all null ids, say) are dealt by their text too
    ordered = source.withColumn("__digest", F.xxhash64("__text")).repartitionByRange(n, "doc_id", "__digest").sortWithinPartitions("doc_id", "__digest", "__text").drop("__digest")

    def close(doc_ids: list, counts: list[np.ndarray], parts: list[np.ndarray], first: int, ends: np.ndarray) -> tuple[pa.RecordBatch, int]:
        ids, lens = np.concatenate(parts), np.concatenate(counts)
        doc_ends = np.cumsum(lens)
        cuts = best_cuts(*_candidates(ids, doc_ends, ends, params), params.window)
        stops = np.union1d(cuts, doc_ends)
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        seq_start = np.concatenate([[0], cuts[:-1]])[seq]
        view = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        owner = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
        long = lambda x: pa.array(x, pa.int64())
        cols = [owner, long(starts - (doc_ends - lens)[doc]), long(stops - starts), long(crc), long(lens[doc]), long(first + seq), long(starts - seq_start)]
        if with_ids:
            cols.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, stops, strict=True)], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=schema.names), first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(ranks_path, params.cache_words, params.special)
        first = TaskContext.get().partitionId() << 40
        doc_ids, counts, parts, held = [], [], [], 0
        for whole in batches:
            for part in slices(whole, "__text"):
                ids, lens = tok.encode(texts_of(part))
                # every text's ids, then the end id
                ended = np.insert(ids, np.cumsum(lens), params.end_id)
                doc_ids += part.column("doc_id").to_pylist()
                counts.append(lens + 1)
                parts.append(ended)
                held += len(ended)
                if held >= params.block_tokens:
                    out, first = close(doc_ids, counts, parts, first, tok.ends)
                    yield out
                    doc_ids, counts, parts, held, out = [], [], [], 0, None
        if held:
            yield close(doc_ids, counts, parts, first, tok.ends)[0]

    return ordered.mapInArrow(run, schema)


def default_ranks() -> str:
    """The ranks file of the public vocabulary (the same ids as its JSON file)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_ranks())
