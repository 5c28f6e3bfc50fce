"""SentencePiece encoding and decoding for merge-type vocabularies.

A unit of text (a run of blank marks and what follows it) is cut into characters; an agenda of
adjacent symbol pairs, ordered by the score of the piece they would make and then from the left,
is worked off until no pair makes a piece. No piece reaches over the start of a unit, so the
distinct units of a batch are encoded once, short ones in step with each other, long ones with a
heap. The sentencepiece library encodes the same units (or whole texts), and both are compared.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import attach, coded, table, texts_of

MARK = "▁"
#: Widths of the tables in which short units are encoded; longer ones go to the heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 48)
#: Symbols that aren't pieces: no symbol, and characters, which follow as UNKNOWN - code point.
NONE, UNKNOWN = -1, -2
_LAST = np.iinfo(np.int32).max


#: Repeated units that a worker remembers with their ids.
KNOWN_UNITS = 1 << 18


@dataclass
class Known:
    """Units and their ids; the other arrays have one more place, for what isn't known."""

    units: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    odd: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))


class MergeVocabulary:
    """A model file's pieces, and which pairs of symbols make which piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)])
        texts = {i: sp.id_to_piece(i) for i in np.nonzero(~special)[0].tolist()}
        symbols = {text: i for i, text in texts.items()}
        # a character inside pieces that is none itself can still be merged: it gets a number of its own
        self.extra = sorted(set(itertools.chain.from_iterable(texts.values())) - set(symbols))
        symbols |= {c: self.size + k for k, c in enumerate(self.extra)}
        self.base = self.size + len(self.extra)
        _, place = np.unique(-np.array([sp.get_score(i) for i in range(self.size)]), return_inverse=True)
        self.rank = np.concatenate([place.astype(np.int32), [_LAST]])  # the last place stands for no piece
        found = {symbols[t[:k]] * self.base + symbols[t[k:]]: i for i, t in texts.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols}
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.chars = UNKNOWN - np.arange(0x110000, dtype=np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.chars[ord(text)] = i
        self.bytes = {sp.id_to_piece(i): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.known = Known()
        #: Whether a piece reaches over the start of a unit; then a text is one unit.
        self.crossing = any(MARK in t.lstrip(MARK) for t in texts.values())

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, NONE where they make none."""
        if not len(self.keys):
            return np.full(left.shape, NONE, np.int32)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.made[at], NONE)

    def work_off(self, symbols: list[int]) -> list[int]:
        """One unit by a heap of pairs; an entry is stale where one of its symbols has changed since."""
        n = len(symbols)
        held, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and held[left] >= 0 and held[right] >= 0:
                piece = self.pairs.get(held[left] * self.base + held[right])
                if piece is not None:
                    heapq.heappush(agenda, (int(self.rank[piece]), left, piece, held[left], held[right]))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, left, piece, a, b = heapq.heappop(agenda)
            right = after[left]
            if held[left] != a or right >= n or held[right] != b:
                continue
            held[left], held[right] = piece, NONE
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [x for x in held if x != NONE]

    def in_step(self, ids: np.ndarray) -> np.ndarray:
        """Many units at once, a row each, filled up with NONE: every round takes the first pair of each row's agenda."""
        out, rows, cols = ids.copy(), np.arange(len(ids)), np.arange(ids.shape[1])
        piece = self.merged(ids[:, :-1], ids[:, 1:])
        while len(rows):
            rank = self.rank[piece]
            best = rank.argmin(1)
            goes = np.take_along_axis(rank, best[:, None], 1)[:, 0] < _LAST
            if not goes.all():
                out[rows[~goes]] = ids[~goes]
                rows, ids, piece, best = rows[goes], ids[goes], piece[goes], best[goes]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            ids[row, best] = piece[row, best]
            closing = cols + (cols > best[:, None])
            ids = np.where(closing < len(cols), np.take_along_axis(ids, np.minimum(closing, len(cols) - 1), 1), NONE)
            closing = np.minimum(closing[:, :-1], len(cols) - 2)  # the last place repeats its neighbour, and is mended below
            piece = np.take_along_axis(piece, closing, 1)
            piece[:, -1] = NONE
            at = np.minimum(best, len(cols) - 2)
            piece[row, at] = self.merged(ids[row, at], ids[row, at + 1])
            prior = np.maximum(best - 1, 0)
            piece[row, prior] = self.merged(ids[row, prior], ids[row, prior + 1])
        return out

    def _final(self, symbols: list[int]) -> list[int]:
        """Symbols as ids: what is no piece becomes its bytes, or one unknown id for each run."""
        out: list[int] = []
        for x in symbols:
            if 0 <= x < self.size:
                out.append(x)
            elif self.bytes:
                char = self.extra[x - self.size] if x >= 0 else chr(UNKNOWN - x)
                out += [self.bytes[f"<0x{b:02X}>"] for b in char.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct units in order, and how many each has."""
        points = np.frombuffer("".join(units.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, lengths = self.chars[points], np.asarray(pc.utf8_length(units)).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        counts, tables, single = np.zeros(len(lengths), np.int64), [], {}
        low = 0
        for width in WIDTHS:
            own = np.nonzero((lengths > low) & (lengths <= width))[0]
            low = width
            if not len(own):
                continue
            there = np.arange(width) < lengths[own][:, None]
            done = self.in_step(np.where(there, symbols[np.minimum(starts[own][:, None] + np.arange(width), len(symbols) - 1)], NONE))
            counts[own] = (done != NONE).sum(1)
            odd = ((done < NONE) | (done >= self.size)).any(1)
            single |= {unit: self._final(row[row != NONE].tolist()) for unit, row in zip(own[odd].tolist(), done[odd], strict=True)}
            tables.append((own[~odd], done[~odd]))
        for unit in np.nonzero(lengths > low)[0].tolist():
            single[unit] = self._final(self.work_off(symbols[starts[unit] : starts[unit] + lengths[unit]].tolist()))
        for unit, ids in single.items():
            counts[unit] = len(ids)
        ends = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), np.int32)
        for own, done in tables:
            full = done != NONE
            flat[((ends - counts)[own][:, None] + np.arange(done.shape[1]))[full]] = done[full]
        for unit, ids in single.items():
            flat[ends[unit] - counts[unit] : ends[unit]] = ids
        return flat, counts

    def units_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of normalised texts in order, and how many each text has."""
        raw = texts.cast(pa.large_binary())
        starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        begin, size = (int(starts[0]), int(starts[-1] - starts[0])) if len(raw) else (0, 0)
        if not size:
            return pa.array([], pa.large_string()), np.zeros(len(raw), np.int64)
        flat = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + size]
        cut = np.zeros(size, bool)
        if not self.crossing:
            mark = MARK.encode()
            at = np.nonzero(flat == mark[0])[0]
            at = at[at + 2 < size]
            at = at[(flat[at + 1] == mark[1]) & (flat[at + 2] == mark[2])]
            cut[at] = True
            cut[at[1:][np.diff(at) == 3]] = False  # inside a run of marks
        inner = starts[:-1] - begin
        cut[inner[inner < size]] = True
        offsets = np.concatenate([np.nonzero(cut)[0], [size]]).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))
        return units, np.diff(np.searchsorted(offsets[:-1], starts - begin))

    def units_in(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The normalised texts as numbers of distinct units, the units, and how many units each text has."""
        units, n_units = self.units_of(pa.array(self.library.normalize(texts), pa.large_string()))
        return *coded(units), n_units

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has."""
        codes, distinct, n_units = self.units_in(texts)
        ids, sizes = self.encode_units(distinct)
        return spelled_out(codes, n_units, ids, np.cumsum(sizes) - sizes, sizes)

    def look_up(self, units: pa.Array, counts: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where each distinct unit's begin in them, how many it has, and whether the library may differ; repeated units are remembered."""
        held = self.known
        at = np.asarray(pc.fill_null(pc.index_in(units, value_set=held.units), -1))
        new = np.nonzero(at < 0)[0]
        fresh = units.take(pa.array(new))
        ids, sizes = self.encode_units(fresh)
        odd = self.differing(fresh, ids, sizes) if check else np.zeros(len(new), bool)
        begins = np.cumsum(sizes) - sizes
        firsts, lengths, doubts = held.firsts[at], held.sizes[at], held.odd[at]  # those of new units are set below
        firsts[new], lengths[new], doubts[new] = len(held.ids) + begins, sizes, odd
        stays = np.nonzero(counts[new] > 1)[0][: KNOWN_UNITS - len(held.units)]
        own = sizes[stays]
        kept = ids[np.repeat(begins[stays] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        out = np.concatenate([held.ids, ids])
        if len(stays):
            self.known = Known(
                pa.concat_arrays([held.units, fresh.take(pa.array(stays))]), np.concatenate([held.ids, kept]), np.concatenate([held.firsts[:-1], len(held.ids) + np.cumsum(own) - own, [0]]),
                np.concatenate([held.sizes[:-1], own, [0]]), np.concatenate([held.odd[:-1], odd[stays], [False]]),
            )
        return out, firsts, lengths, doubts

    def differing(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which distinct units the library encodes otherwise, or may be given otherwise than they stand in a text.

        The library puts a mark before every text, so it gets a unit without its first mark.
        """
        bare = [u[1:] for u in units.to_pylist()]
        theirs = self.library.encode(bare, num_threads=1) if bare else []
        lengths = np.fromiter(map(len, theirs), np.int64, len(theirs))
        if np.array_equal(lengths, sizes) and np.array_equal(np.fromiter(itertools.chain.from_iterable(theirs), np.int32, len(ids)), ids):
            odd = np.zeros(len(bare), bool)
        else:
            ends = np.cumsum(sizes)
            odd = np.array([x != ids[end - n : end].tolist() for x, n, end in zip(theirs, sizes.tolist(), ends.tolist(), strict=True)], bool)
        if not self.bytes and bare:  # ids tell the text only where no character is unknown
            odd |= ~np.asarray(pc.equal(pa.array(self.library.normalize(bare), pa.large_string()), units).cast(pa.uint8()), dtype=bool)
        return odd


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> MergeVocabulary:
    """The vocabulary of a model file, kept by a worker from task to task."""
    return MergeVocabulary(path)


def spelled_out(codes: np.ndarray, n_units: np.ndarray, ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as numbers of units, and how many each text has."""
    own = sizes[codes]
    ends = np.cumsum(own)
    flat = ids[np.repeat(firsts[codes] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
    before, last = np.concatenate([[0], ends]), np.cumsum(n_units)
    return flat, before[last] - before[last - n_units]


def _lists(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Numbers of rows given one after the other."""
    numbers, ends = flat.tolist(), np.cumsum(counts).tolist()
    return [numbers[end - n : end] for end, n in zip(ends, counts.tolist(), strict=True)]


def _checked(vocabulary: MergeVocabulary, texts: list[str], check: str) -> tuple[list[list[int]], pa.Array, list[bool]]:
    """Ids of each text, as lists and as a column, and whether the library's are the same; where they may not be, the library's count."""
    codes, distinct, n_units = vocabulary.units_in(texts)
    ids, firsts, sizes, odd = vocabulary.look_up(distinct, np.bincount(codes, minlength=len(distinct)), check == "units")
    flat, counts = spelled_out(codes, n_units, ids, firsts, sizes)
    made = _lists(flat, counts)
    if check == "units":
        doubtful = np.nonzero(np.bincount(np.repeat(np.arange(len(texts)), n_units), weights=odd[codes], minlength=len(texts)))[0].tolist()
    else:
        doubtful = list(range(len(texts)))
    agrees = [True] * len(texts)
    for k, theirs in zip(doubtful, vocabulary.library.encode([texts[k] for k in doubtful], num_threads=1) if doubtful else [], strict=True):
        agrees[k] = made[k] == theirs
        made[k] = theirs
    whole = all(agrees)
    return made, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat)) if whole else pa.array(made, pa.list_(pa.int32())), agrees


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", check: str = "units") -> DataFrame:
    """All columns, ``ids`` (array of int), ``decoded`` (the library's text of these ids) and ``agrees``.

    ``ids`` are those of the agenda wherever the library gives the same (``agrees``), else the
    library's: a vocabulary with user-defined or unused pieces, or one that isn't of the merge
    type, may need that. check: ``units`` has the library encode each distinct unit of a batch, and
    whole texts where one differs; ``texts`` has it encode every text. No begin or end ids, no sampling. Null and empty texts have no ids and
    decode to the empty text; texts are encoded whole, whatever their length; repeated rows are
    encoded alike; an empty table gives an empty one. Input columns of the three names are replaced.
    ``model_path`` has to be readable on every executor.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())]

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        vocabulary = loaded(model_path)
        ids, column, agrees = _checked(vocabulary, texts_of(part).to_pylist(), check)
        return [column, pa.array(vocabulary.library.decode(ids, num_threads=1) if ids else [], pa.string()), pa.array(agrees, pa.bool_())]

    return attach(docs, text_col, run, fields)


def decode_documents(rows: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and ``into``, the library's text of the ids of each row; null ids give the empty text, an id outside the vocabulary raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            ids = [x or [] for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{k}") for k in range(len(names))], pa.array(library.decode(ids, num_threads=1) if ids else [], pa.string())], names=[*names, into])

    kept = [c for c in rows.columns if c.lower() != into.lower()]
    names = list(kept)
    source = rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    return source.mapInArrow(run, T.StructType([*rows.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(into, T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the text decoded from them."""
    made = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees"
    )
