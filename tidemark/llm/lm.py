"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision node has a context tree of ``depth`` bytes.
Krichevsky-Trofimov estimates of all depths are mixed bottom-up into weighted probabilities, and
top-down into one predictive probability per context and byte. Counts come from all training
texts. N-grams are dealt by their last ``BASE`` context bytes; what lies deeper is a subtree of
its own and is mixed in Arrow where it lies, the levels above are tables. So the model grows with
the corpus and no worker holds it: frequent entries are broadcast (their number is bounded by
their share of all tokens), the rest is looked up by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import coded, discard, segment_sums, slices, stored, table, texts_of, words_of

DEPTH = 4
#: Depth of the registered query.
QUERY_DEPTH = 6
#: Context bytes by which n-grams are dealt, and n-grams mixed at a time (those of one such context stay together).
BASE, CHUNK = 4, 1 << 18
#: Bytes of text handled at a time: every byte takes some sixty bytes of work space.
SLICE = 1 << 20
#: An entry is frequent if it makes up at least one in so many of all; there are no more than this.
HEAD_WORDS, HEAD_GRAMS = 1 << 20, 1 << 24
#: Distinct n-grams that a worker counts before it hands them on.
HELD_GRAMS = 3 << 19


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - F.log(product)


def log_kt(a0: Column, a1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a0 zeros and a1 ones."""
    return lgamma(a0 + 0.5) + lgamma(a1 + 0.5) - lgamma(a0 + a1 + 1.0) - math.log(math.pi)


def _lgammas(last: int, shift: float) -> np.ndarray:
    return np.array([math.lgamma(k + shift) for k in range(last)])


_HALF, _ONE = _lgammas(1 << 12, 0.5), _lgammas(1 << 12, 1.0)


def _table_lgamma(k: np.ndarray, known: np.ndarray, shift: float) -> np.ndarray:
    """ln gamma(k + shift) of whole numbers k: from a table, by Stirling's series beyond it."""
    out = known[np.minimum(k, len(known) - 1).astype(np.int64)]
    big = np.nonzero(k >= len(known))[0]
    if len(big):
        y = k[big] + shift
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def _mixed(grams: np.ndarray, n: np.ndarray, depth: int, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight decisions the mix of depths ``base`` to ``depth``, over all n-grams of whole contexts of ``base`` bytes.

    Yields the nodes' first n-grams (cut to ``base`` context bytes), their zeros, ones and ln of the weighted
    probability, and the predictive probability of a one for every n-gram.
    """
    above = []
    order = np.argsort(grams)
    keys, counts = [grams[order]], [n[order].astype(float)]
    for d in range(depth - 1, base - 1, -1):
        key, inverse = np.unique(keys[-1] & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(inverse, weights=counts[-1], minlength=len(key)))
        above.append(inverse)
    for k in range(8):
        nodes = []  # by level, from the deepest: node of each row, first row, estimate, weight of staying
        for level, (key, c) in enumerate(zip(keys, counts, strict=True)):
            prefix = key >> np.uint64(8 - k)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first, node = np.nonzero(new)[0], np.cumsum(new) - 1
            total = np.add.reduceat(c, first)
            ones = np.add.reduceat(c * ((key >> np.uint64(7 - k)) & np.uint64(1)), first)
            kt = _table_lgamma(total - ones, _HALF, 0.5) + _table_lgamma(ones, _HALF, 0.5) - _table_lgamma(total, _ONE, 1.0) - math.log(math.pi)
            stay, weighted = None, kt
            if level:
                below = np.bincount(node[above[level - 1][nodes[-1][1]]], weights=lower, minlength=len(first))
                weighted = np.logaddexp(kt, below) - math.log(2)
                stay = np.exp(kt - weighted - math.log(2))
            lower = weighted
            nodes.append((node, first, (ones + 0.5) / (total + 1.0), stay))
        row = np.arange(len(grams))
        p = nodes[0][2][nodes[0][0]]
        for level in range(1, len(keys)):
            row = above[level - 1][row]
            at = nodes[level][0][row]
            p = nodes[level][3][at] * nodes[level][2][at] + (1 - nodes[level][3][at]) * p
        back = np.empty(len(grams))
        back[order] = p
        yield keys[-1][first], total - ones, ones, weighted, back


def _node(gram: np.ndarray, k: int) -> np.ndarray:
    return (1 << k) | ((gram & np.uint64(255)).astype(np.int64) >> (8 - k))


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``ctx`` in tables of about CHUNK rows that cut no context apart."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            ctx = np.asarray(batch.column("ctx"))
            cut = int(np.searchsorted(ctx, ctx[-1]))  # the last context may go on
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held, size = [batch.slice(cut)], batch.num_rows - cut
            elif np.asarray(held[0].column("ctx"))[0] != ctx[-1]:
                whole = pa.Table.from_batches(held)
                cut = int(np.searchsorted(np.asarray(whole["ctx"]), ctx[-1]))
                yield whole.slice(0, cut)
                held, size = whole.slice(cut).to_batches(), whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _grams(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams (``depth`` context bytes and the byte, as one number) of all texts, and how many each text has.

    A text starts in a context of bytes 0 and ends with a byte 0.
    """
    raw = texts.cast(pa.large_binary())
    lengths = np.asarray(pc.binary_length(raw)).astype(np.int64)
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[np.frombuffer(raw.buffers()[1], np.int64)[raw.offset] :][: lengths.sum()] if len(raw) and lengths.sum() else np.zeros(0, np.uint8)
    sizes = lengths + depth + 1
    starts = np.cumsum(sizes) - sizes
    buf = np.zeros(sizes.sum(), np.uint8)
    if len(flat):
        buf[np.arange(len(flat)) + np.repeat(starts + depth - (np.cumsum(lengths) - lengths), lengths)] = flat
    g = buf.astype(np.uint64)
    for k in range(1, depth + 1):
        g[k:] |= buf[:-k].astype(np.uint64) << np.uint64(8 * k)
    first = np.zeros(len(buf), bool)
    for k in range(depth):
        first[starts + k] = True
    return g[~first], lengths + 1


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(source: DataFrame) -> DataFrame:
    """``(word, c)`` over the training rows of ``(held_out, __text)``."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held: list[pa.Table] = []
            for part in slices(whole, "__text", SLICE):
                words, _ = words_of(pc.ascii_lower(texts_of(part)))
                codes, distinct = coded(words)
                held.append(pa.table({"word": distinct.cast(pa.large_string()), "c": pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())}))
            if held:
                merged = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
                yield from pa.table({"word": merged["word"].cast(pa.string()), "c": merged["c_sum"]}).to_batches(max_chunksize=200_000)

    return source.filter("not held_out").mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0] if len(ordered) else np.zeros(0, np.int64)


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs; sorts in place."""
    grams.sort()
    first = _runs(grams)
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of several counts."""
    grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(grams)
    grams = grams[order]
    first = _runs(grams)
    return grams[first], np.add.reduceat(n[order], first) if len(first) else n


def gram_counts(source: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(gram, n)``: all byte n-grams of all rows, n counted in training rows."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams, n = _merged(held)
        yield from pa.table({"gram": grams.astype(np.int64), "n": n.astype(np.int64)}).to_batches(max_chunksize=200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for whole in batches:
            for part in slices(whole, "__text", SLICE):
                grams, counts = _grams(texts_of(part), depth)
                train = np.repeat(~np.asarray(part.column("held_out")).astype(bool), counts)
                held.append(_counted(grams[train]))
                listed = _counted(grams[~train])[0]
                held.append((listed, np.zeros(len(listed), np.int64)))
                size += len(held[-2][0]) + len(listed)
                if size > HELD_GRAMS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS * 2 // 3:
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(held)

    return source.mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n"))


def context_tree(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(gram, lp, n)``, stored: log10 of the weighted probability of every listed n-gram's last byte in its context."""
    base = min(depth, BASE)
    ctx = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * base)) - 1))
    dealt = grams.select(ctx.alias("ctx"), "gram", "n")
    level_schema = T.StructType([T.StructField("ctx", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("a0", T.DoubleType()), T.StructField("a1", T.DoubleType()), T.StructField("lpw", T.DoubleType())])

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_contexts(batches):
            found = _mixed(np.asarray(part["gram"]).astype(np.uint64), np.asarray(part["n"]), depth, base)
            for k, (first, zeros, ones, weighted, _) in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array((first >> np.uint64(8)).astype(np.int64)), pa.array(_node(first, k), pa.int32()), pa.array(zeros), pa.array(ones), pa.array(weighted)], names=level_schema.names)

    # a context's n-grams lie together: at most those with one of 2^32 endings
    level = stored(dealt.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(subtrees, level_schema), "tree")
    deepest, above = level, []
    for d in range(base - 1, -1, -1):
        up = level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("ctx"), "node").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"), F.sum("lpw").alias("below"))
        up = up.withColumn("lkt", log_kt(F.col("a0"), F.col("a1")))
        top = F.greatest("lkt", "below")
        up = up.withColumn("lpw", top + F.log(F.exp(F.col("lkt") - top) + F.exp(F.col("below") - top)) - math.log(2))
        level = stored(up.select("ctx", "node", "a0", "a1", "lpw", F.exp(F.col("lkt") - F.col("lpw") - math.log(2)).alias("stay")), "tree")
        above.append(level)
    # mix top-down: at each depth the estimate stays with weight `stay`, and goes deeper otherwise;
    # the mix is `own` plus `share` of what the subtree says
    mixed = deepest.select("ctx", "node", F.lit(0.0).alias("own"), F.lit(1.0).alias("share"))
    for d, level in zip(range(base - 1, -1, -1), above, strict=True):
        here = level.select(F.col("ctx").alias("c"), F.col("node").alias("m"), ((F.col("a1") + 0.5) / (F.col("a0") + F.col("a1") + 1.0)).alias("kt"), "stay")
        if d <= 1:  # 255 nodes of at most 256 contexts
            here = F.broadcast(here)
        key = F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        go = 1 - F.col("stay")
        mixed = mixed.join(here, (key == F.col("c")) & (F.col("node") == F.col("m"))).select("ctx", "node", (F.col("stay") * F.col("kt") + go * F.col("own")).alias("own"), (go * F.col("share")).alias("share"))
    upper = mixed.select("ctx", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("n"), "node", "own", "share")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("node", "int"), ("own", "double"), ("share", "double"))]
    model_schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("lp", T.DoubleType()), T.StructField("n", T.LongType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_contexts(batches):
            is_gram = part["gram"].is_valid()
            mine, up = part.filter(is_gram), part.filter(pc.invert(is_gram))
            own_grams = np.asarray(mine["gram"]).astype(np.uint64)
            keys = np.asarray(up["ctx"]).astype(np.int64) << 8 | np.asarray(up["node"]).astype(np.int64)
            order = np.argsort(keys)
            keys, own, share = keys[order], np.asarray(up["own"])[order], np.asarray(up["share"])[order]
            short = np.asarray(mine["ctx"]).astype(np.int64) << 8
            lp = np.zeros(len(own_grams))
            for k, (*_, p) in enumerate(_mixed(own_grams, np.asarray(mine["n"]), depth, base)):
                at = np.searchsorted(keys, short | _node(own_grams, k))
                p = own[at] + share[at] * p
                lp += np.log10(np.where((own_grams >> np.uint64(7 - k)) & np.uint64(1) == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([mine["gram"].combine_chunks(), pa.array(lp), mine["n"].combine_chunks()], names=model_schema.names)

    both = dealt.select("ctx", "gram", "n", *none).unionByName(upper)
    model = stored(both.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(predict, model_schema), "model")
    discard(deepest, *above)
    return model


def _lists(owner: np.ndarray, n_docs: int, values: pa.Array, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.searchsorted(owner, np.arange(n_docs + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))


def _per_doc(codes: np.ndarray, counts: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs among the wanted positions: text, code, times."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    pair, n = np.unique(doc[wanted] * width + codes[wanted], return_counts=True)
    return pair // width, pair % width, n


def score_texts(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Rows whose crc32 of the id (as text) is divisible by 10 are held out; the others train, and
    a row with a null id trains too. base_score: log10 probability by smoothed word counts.
    score: log10 probability of the text's bytes and its end by context-tree weighting over
    contexts of 0 to ``depth`` bytes (7 at most).
    bits_per_byte: code length of the text and its end, by byte. Null text counts as empty.
    """
    if not 0 <= depth <= 7:
        raise ValueError("depth must be 0 to 7")
    spark = docs.sparkSession
    source = docs.select("doc_id", _held_out().alias("held_out"), F.col(f"`{text_col}`").alias("__text"))
    words = stored(word_counts(source), "words")
    grams = stored(gram_counts(source, depth), "grams")
    model = context_tree(grams, depth)
    discard(grams)
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train = source.filter("not held_out").count()
    total, vocab = seen["n"] + n_train, seen["v"] + (1 if n_train else 0)  # every training text adds an end
    weight = total + 0.1 * (vocab + 1)
    n_grams = model.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    top_words = words.filter(F.col("c") * HEAD_WORDS >= total).toArrow()  # at most HEAD_WORDS rows
    top_grams = model.filter((F.col("n") > 0) & (F.col("n") * HEAD_GRAMS >= n_grams)).select("gram", "lp").toArrow()
    top_keys = np.asarray(top_grams["gram"]).astype(np.uint64)
    by_key = np.argsort(top_keys)
    head = spark.sparkContext.broadcast((
        pa.concat_arrays([c.cast(pa.large_string()) for c in top_words["word"].chunks] or [pa.array([], pa.large_string())]), np.log10((np.asarray(top_words["c"]).astype(float) + 0.1) / weight),
        top_keys[by_key], np.asarray(top_grams["lp"]).astype(float)[by_key],
    ))
    schema = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_words", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("word_sum", T.DoubleType()), T.StructField("gram_sum", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.StringType())), T.StructField("word_n", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("gram_n", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_log, keys, lps = head.value
        rid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for part in slices(whole, "__text", SLICE):
                texts = texts_of(part)
                n = len(texts)
                tokens, counts = words_of(pc.ascii_lower(texts))
                codes, distinct = coded(tokens)
                at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=top), -1)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
                value = np.where(at >= 0, top_log[np.maximum(at, 0)] if len(top_log) else 0.0, 0.0)
                rare = (at < 0)[codes] if len(codes) else np.zeros(0, bool)
                doc, code, times = _per_doc(codes, counts, rare, max(1, len(distinct)))
                word_lists = _lists(doc, n, distinct.take(pa.array(code)).cast(pa.string()), times)
                grams, n_bytes = _grams(texts, depth)
                owner = np.repeat(np.arange(n, dtype=np.int32), n_bytes)
                order = np.argsort(grams)
                grams, owner = grams[order], owner[order]
                first = _runs(grams)
                seen_once = grams[first]
                where = np.minimum(np.searchsorted(keys, seen_once), max(0, len(keys) - 1))
                hit = keys[where] == seen_once if len(keys) else np.zeros(len(first), bool)
                times_each = np.diff(np.concatenate([first, [len(grams)]]))
                got = np.bincount(owner, np.repeat(np.where(hit, lps[where], 0.0) if len(keys) else np.zeros(len(first)), times_each), minlength=n)
                missed = ~np.repeat(hit, times_each)
                g, o = grams[missed], owner[missed]
                order = np.argsort(o, kind="stable")
                g, o = g[order], o[order]
                first = np.nonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]))[0] if len(g) else np.zeros(0, np.int64)
                gram_lists = _lists(o[first].astype(np.int64), n, pa.array(g[first].astype(np.int64), pa.int64()), np.diff(np.concatenate([first, [len(g)]])))
                long = lambda x: pa.array(x, pa.int64())
                cols = [long(np.arange(rid, rid + n)), part.column("doc_id"), part.column("held_out"), long(counts), long(n_bytes), long(segment_sums((~rare).astype(np.int64), counts)),
                        pa.array(np.bincount(np.repeat(np.arange(n), counts), value[codes], minlength=n)), pa.array(got), *word_lists, *gram_lists]
                rid += n
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    scored = stored(source.mapInArrow(run, schema), "scored")
    rare_words = scored.select("rid", F.explode(F.arrays_zip("words", "word_n")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.word_n").alias("times"))
    rare_words = rare_words.join(words.hint("shuffle_hash"), "word", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(weight))).alias("more_words"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more_known")
    )
    rare_grams = scored.select("rid", F.explode(F.arrays_zip("grams", "gram_n")).alias("x")).select("rid", F.col("x.grams").alias("gram"), F.col("x.gram_n").alias("times"))
    rare_grams = rare_grams.join(model.select("gram", "lp").hint("shuffle_hash"), "gram").groupBy("rid").agg(F.sum(F.col("times") * F.col("lp")).alias("more_grams"))
    rows = scored.drop("words", "word_n", "grams", "gram_n").join(rare_words, "rid", "left").join(rare_grams, "rid", "left")
    zero = F.lit(0.0)
    n_tokens = F.col("n_words") + 1
    score = F.col("gram_sum") + F.coalesce("more_grams", zero)
    return rows.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if n_train else 0)).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("word_sum") + F.coalesce("more_words", zero) + F.lit(math.log10((n_train + 0.1) / weight))).alias("base_score"),
        score.alias("score"), (-score / (F.lit(math.log10(2)) * F.col("n_bytes"))).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), depth=QUERY_DEPTH)
