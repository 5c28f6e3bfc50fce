"""N-gram Jaccard join by MinHash banding.

1. Every document's word n-grams are hashed; documents with the same n-gram set form one node.
2. Nodes are shuffled on the hashes of signature bands. Sharing a bucket makes two nodes
   candidates; buckets are linked as stars of ids, so the candidate graph stays linear in size.
3. Pairs are verified on the full n-gram sets by counting intersections, in blocks of bounded size:
   all pairs of a candidate component where it is dense, the pairs of each bucket (judged in the
   first one they share) where a component is a wide, sparse chain. Blocks give counts of links per
   node and a spanning forest of the verified links, never the pairs themselves.
4. Connected components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import coded, discard, mix64, slices, stored, table, texts_of, words_of


def choose_bands(threshold: float, recall: float, most_rows: int = 4) -> tuple[int, int]:
    """Bands and rows so that a pair at the threshold shares a band with at least the given probability.

    Rows are as many as ``most_rows`` allows: more rows mean fewer false candidates, and more bands.
    """
    rows = max(1, most_rows)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def _gram_sets(batch: pa.RecordBatch, n_words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, one without words has none."""
    words, counts = words_of(texts_of(batch))
    codes, distinct = coded(words)
    hashes = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in distinct.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(distinct))
    w = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts:
        own = w[at : at + c]
        at += c
        n = min(n_words, c)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        key = own[: c - n + 1]
        for k in range(1, n):
            key = mix64(key) + own[k : c - n + 1 + k]
        key = np.sort(mix64(key))
        out.append(key[np.concatenate([[True], key[1:] != key[:-1]])])
    return out


def _signature(grams: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1 << 13):
        part = grams[at : at + (1 << 13)]
        for k in range(len(mul)):
            m = (part * mul[k] + add[k]).min()
            if m < low[k]:
                low[k] = m
    return low


def signatures(docs: DataFrame, n_words: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """``(doc_id, key, node, bands, n_grams)`` of ``(doc_id, key, __text)``: node digests the n-gram set, null where there are no words."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["key"], T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n_grams", T.LongType())])
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for part in slices(whole, "__text"):
                    sets = _gram_sets(part, n_words)
                    made = []
                    for grams in sets:
                        if not len(grams):
                            made.append(None)
                            continue
                        sig = _signature(grams, mul, add).reshape(bands, rows)
                        key = np.zeros(bands, np.uint64)
                        for r in range(rows):
                            key = mix64(key + sig[:, r])
                        made.append(key.view(np.int64))
                    nodes = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None for g in sets]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("key"), pa.array(nodes, pa.binary()), pa.array(made, pa.list_(pa.int64())), pa.array([len(g) for g in sets], pa.int64())],
                        names=schema.names,
                    )

    return docs.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(v, c)``: the smallest vertex of every vertex's connected component, for edges ``(a, b)``.

    Alternating large-star and small-star steps over a table of edges; what a round writes is
    deleted when the next one is done. Every vertex of an edge is returned; loops are allowed.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours larger than the vertex go to its smallest neighbour (itself counted)
        # both sides of each join are written first, so that it can split a hot vertex
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
        # small star: the smaller neighbours and the vertex itself go to the smallest of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a")
        new = stored(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").filter("a <> b").distinct(), "edges")
        # done when every vertex has one smaller neighbour that has none itself
        heads = new.select("a").distinct()
        open_ = new.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a").limit(1).count()
        deep = 0 if open_ else new.join(heads.withColumnRenamed("a", "b"), "b", "left_semi").limit(1).count()
        discard(e, low, large, least)
        e = new
        if not open_ and not deep:
            break
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return vertices.join(e.select(F.col("a").alias("v"), F.col("b").alias("c")), "v", "left").select("v", F.coalesce("c", "v").alias("c"))


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float, slab: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) between rows ``left`` and ``right`` whose sets reach the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    group = np.cumsum(new) - 1
    n_in = np.bincount(group)
    often = n_in[group] > 1  # grams of one row alone meet nothing
    owner, group = owner[often], group[often]
    if len(group):
        group = np.unique(group, return_inverse=True)[1]
    overlap = np.zeros((len(left), len(right)), np.float32)
    pos_l, pos_r = np.full(len(sets), -1), np.full(len(sets), -1)
    pos_l[left], pos_r[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(group[-1]) + 1 if len(group) else 0, slab):
        inside = slice(*np.searchsorted(group, [at, at + slab]))
        g, o = group[inside] - at, owner[inside]
        a, b = np.zeros((len(left), slab), np.float32), np.zeros((len(right), slab), np.float32)
        ok = pos_l[o] >= 0
        a[pos_l[o[ok]], g[ok]] = 1
        ok = pos_r[o] >= 0
        b[pos_r[o[ok]], g[ok]] = 1
        overlap += a @ b.T
    total = sizes[left][:, None] + sizes[right][None, :] - overlap
    hit = overlap >= threshold * total
    i, j = np.nonzero(hit)
    keep = (left[i] < right[j]) if same else np.ones(len(i), bool)
    return left[i[keep]], right[j[keep]]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component under the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def ngram_join(docs: DataFrame, text_col: str = "text", n_words: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 4, block_rows: int = 384, block_grams: int = 2_000_000, judged_rows: int = 384) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, set_id, n_copies, n_links, n_grams``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. set_id: the smallest id among
    documents with the same n-gram set; n_copies: how many they are; n_links: how many other
    n-gram sets reach the threshold with this one; class_id: the smallest id among all documents
    connected by equal sets and links. A document of fewer than ``n_words`` words has one n-gram
    of all its words. Null, empty and blank texts have no n-grams: class_id and set_id are their
    own id, n_copies is 1, n_links 0. Null ids are carried and never chosen as the smallest id
    unless the whole class has none. Repeated rows count as copies; other columns are not carried.

    Which links count: all pairs inside a component of candidates, whether they share a bucket or
    not; but in a wide and sparse component (over ``judged_rows`` sets, and cheaper to judge bucket by
    bucket) those that share one. At the threshold a pair shares one with probability ``recall``.
    Neither depends on ``block_rows`` and ``block_grams``, which only bound what a task holds.
    """
    out = _classes(docs, text_col, n_words, threshold, recall, rows, block_rows, block_grams, judged_rows)
    own = F.col("node").isNull()
    return out.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_grams",
    )


def _text_key(text: str) -> Column:
    """A digest of a row's text, null as empty."""
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


#: N-grams of a block by which a component is found to be sparse.
JUDGED_GRAMS = 2_000_000


def _width(n: Column, grams: Column, block_rows: int, block_grams: int) -> Column:
    """Blocks of a group: as few as the bounds allow, but one that needs several gets up to twenty, so that many tasks share its pairs."""
    spread = F.when(n > block_rows, F.least(F.ceil(n / F.lit(max(1, block_rows // 3))), F.lit(20))).otherwise(1)
    return F.greatest(F.ceil(n / F.lit(block_rows)), F.ceil(grams / F.lit(float(block_grams))), spread).cast("int")


def _groups(keyed: DataFrame, buckets: DataFrame, candidates: DataFrame, sizes: DataFrame, block_rows: int, block_grams: int, judged_rows: int) -> DataFrame:
    """``(node, g, band, nb)``: the groups inside which each candidate's pairs are verified, cut into ``nb`` blocks.

    A component is one group (band null) unless its buckets, each taken for itself, need fewer
    copies of its n-gram sets, in blocks of ``judged_rows``. Buckets of the same nodes count once, in
    their first band.
    """
    blocks = lambda n, grams: [_width(F.col(n), F.col(grams), block_rows, block_grams).alias("nb"), _width(F.col(n), F.col(grams), judged_rows, JUDGED_GRAMS).alias("judged")]
    members = stored(candidates.join(sizes, "node"), "members")
    whole = members.groupBy("c").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    whole = whole.select("c", "n", *blocks("n", "grams"))
    apart = buckets.groupBy("low", "high", "n", "x", "y").agg(F.min(F.struct("band", "key")).alias("at"), F.max("grams").alias("grams"))
    apart = apart.select("at.band", "at.key", "low", "n", *blocks("n", "grams"))
    apart = stored(apart.join(candidates.select(F.col("node").alias("low"), "c"), "low").select("band", "key", "c", "n", "nb", "judged"), "distinct-buckets")
    cost = apart.groupBy("c").agg(F.sum(F.col("n") * F.col("judged")).alias("cost"))
    # written first, so that the joins can split a hot component
    width = stored(whole.join(cost, "c").select("c", "nb", (F.col("cost") < F.col("n") * F.col("judged")).alias("sparse")), "widths")
    dense = members.join(width.filter("not sparse"), "c").select("node", F.col("c").alias("g"), F.lit(None).cast("int").alias("band"), "nb")
    chosen = stored(apart.join(width.filter("sparse").select("c"), "c").select("band", "key", "nb"), "chosen-buckets")
    name = F.unhex(F.md5(F.concat_ws(":", "band", "key")))
    sparse = keyed.join(chosen, ["band", "key"]).select("node", name.alias("g"), "band", "nb")
    return dense.unionByName(sparse)


def _classes(docs: DataFrame, text_col: str, n_words: int, threshold: float, recall: float, rows: int, block_rows: int, block_grams: int, judged_rows: int) -> DataFrame:
    """All rows by id and text digest (``key``) with their node, component ``c``, and the join's figures; nulls where there are no n-grams."""
    n_bands, n_rows = choose_bands(threshold, recall, rows)
    source = docs.select("doc_id", _text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("__text"))
    sig = stored(signatures(source, n_words, n_bands, n_rows), "signatures")
    nodes = sig.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"))
    reps = stored(sig.filter("node is not null").select("node", "bands", "n_grams", F.col("doc_id").alias("__id"), F.col("key").alias("__key")).dropDuplicates(["node"]), "nodes")

    keyed = reps.select("node", "n_grams", F.posexplode("bands").alias("band", "key"))
    # written first, so that the join's two sides are both dealt by it and a hot bucket can be split
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(x) for i, x in enumerate("xy")]
    buckets = keyed.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.sum("n_grams").alias("grams"), *mark)
    buckets = stored(buckets.filter("low <> high"), "buckets")
    edges = keyed.join(buckets.select("band", "key", "low"), ["band", "key"]).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    edges = stored(edges, "candidate-edges")
    candidates = stored(components(edges).withColumnRenamed("v", "node"), "candidates")

    # the full sets of the candidates only: the text of one document per node, by its id and digest
    wanted = stored(candidates.select("node").join(reps.select("node", "__id", "__key", "bands"), "node"), "wanted")
    picked = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).drop("doc_id", "key", "__id", "__key")
    set_schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("grams", T.BinaryType())])

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for part in slices(whole, "__text"):
                    sets = _gram_sets(part, n_words)
                    same = [len(g) > 0 and hashlib.blake2b(g.tobytes(), digest_size=16).digest() == n for g, n in zip(sets, part.column("node").to_pylist(), strict=True)]
                    cols = [part.column("node"), part.column("bands"), pa.array([g.tobytes() for g in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=set_schema.names).filter(pa.array(same))

    # repeated rows have the same text
    sets = stored(picked.mapInArrow(full_sets, set_schema), "sets").dropDuplicates(["node"])
    groups = _groups(keyed, buckets, candidates, reps.select("node", "n_grams"), block_rows, block_grams, judged_rows)
    blk = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    placed = stored(groups.withColumn("blk", blk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))), "placed")
    bands = F.when(F.col("band").isNotNull(), F.col("bands")).alias("bands")  # sparse groups need them
    spread = placed.join(sets, "node").select("node", "g", "band", "blk", bands, "grams", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    link_schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("n", T.LongType())])

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        nodes_ = group.column("node").to_pylist()
        n = len(nodes_)
        empty = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        if n < 2:
            return empty
        sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        blk = np.array(group.column("blk").to_pylist())
        left, right = np.nonzero(blk == i)[0], np.nonzero(blk == j)[0]
        if not len(left) or not len(right):
            return empty
        a, b = _links(sets, left, right, i == j, threshold)
        band = group.column("band")[0].as_py()
        if band is not None and len(a):  # a pair counts in the first bucket that it shares
            keys = np.array(group.column("bands").to_pylist(), np.int64)
            mine = (keys[a] == keys[b]).argmax(1) == band
            a, b = a[mine], b[mine]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        label = _forest(n, a, b)
        some = np.nonzero(degree)[0]
        return pa.table({"a": pa.array([nodes_[x] for x in some], pa.binary()), "b": pa.array([nodes_[label[x]] for x in some], pa.binary()), "n": pa.array(degree[some], pa.int64())})

    links = stored(spread.groupBy("g", "i", "j").applyInArrow(verify, link_schema), "links")
    discard(placed, buckets, edges, wanted)
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = components(links.select("a", "b")).withColumnRenamed("v", "node")
    joined = stored(nodes.join(classes, "node", "left").join(degrees, "node", "left").withColumn("c", F.coalesce("c", "node")), "node-classes")
    # both written first, so that the join can split a hot class
    lowest = stored(joined.groupBy("c").agg(F.min("set_id").alias("class_id")), "lowest")
    judged = joined.join(lowest, "c").select("node", "c", "class_id", "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return sig.select("doc_id", "key", "node", "n_grams").join(judged, "node", "left")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, copies and number of links."""
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class stays: the one of the smallest id.

    Null ids are larger than all others; of several rows of that id the one whose text, then whose
    other columns, have the smallest digest stays, so repeated rows become one. Null, empty and
    blank texts are no duplicates of other ids' texts. Columns of any name pass through.
    """
    found = _classes(docs.select("doc_id", "text"), "text", 5, 0.8, 0.9999, 4, 384, 2_000_000, 384)
    # of each class the smallest id stays (null only where there is no other), of equal ids one text; rows without n-grams are their own class
    group = F.when(F.col("c").isNotNull(), F.hex("c")).otherwise(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key"))
    keep = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("key").alias("key"))).alias("m")).select("m.id", "m.key")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]))
    place = lambda i, k: [F.coalesce(F.col(i).cast("string"), F.lit("")).alias("of"), F.col(i).isNull().alias("no"), F.col(k).alias("digest")]
    rows = docs.select(F.col("doc_id").alias("id"), _text_key("text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(others).alias("rest"))
    rows = rows.select(*place("id", "key"), "row", "rest")
    # rows of one id and text are few: partial aggregation leaves one for each task before the shuffle, which the join then uses too
    one = rows.groupBy("of", "no", "digest").agg(F.min_by("row", "rest").alias("row"))
    kept = one.join(keep.select(*place("id", "key")).hint("merge"), ["of", "no", "digest"], "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
