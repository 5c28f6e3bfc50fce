"""Line dedup over levelled sorted runs.

A run is a bucketed, sorted table ``(h, n_docs, max_doc)``: one row per line key hash.  Batches
of documents arrive from the highest ids to the lowest, so the first batch that holds a key also
holds its largest document.  Every batch is merge-anti-joined with the runs' settled keys (keys
already found in enough documents need nothing more), and adds its own run at level 0; when a
level holds ``fanout`` runs they are merged into one run of the next level by sort-merge full
outer joins of equal buckets, without a shuffle.  The compacted run then decides every line.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import numbered, remove_path, scratch, stored, table, without

#: White space stripped from both ends of a line to make its key.
BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "run")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _merge(self, names: list[str]) -> str:
        merged = self.spark.table(names[0])
        for name in names[1:]:
            a, b = merged.alias("a"), self.spark.table(name).alias("b")
            merged = a.join(b.hint("merge"), F.expr("a.h = b.h"), "full_outer").select(
                F.expr("coalesce(a.h, b.h)").alias("h"),
                F.expr("coalesce(a.n_docs, 0L) + coalesce(b.n_docs, 0L)").alias("n_docs"),
                F.expr("greatest(a.max_doc, b.max_doc)").alias("max_doc"),
            )
        out = self._write(merged)
        self._remove(names)
        return out

    def _remove(self, names: list[str]) -> None:
        """Drop runs that are not needed any more, with their files."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch ``(doc_id, h)``; its documents have lower ids than all before and none of the same id."""
        # distinct rows are dealt by both columns; what is then dealt by key is one partial count for each task
        own = keys.distinct().groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        for name in self.runs():
            settled = self.spark.table(name).filter(F.col("n_docs") >= self.min_docs).select("h")
            own = own.join(settled.hint("merge"), "h", "left_anti")
        self.levels[0].append(self._write(own.repartition(self.buckets, "h")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(self.levels[level]))
            self.levels[level] = []
            level += 1

    def compacted(self) -> DataFrame:
        """All runs merged into one."""
        names = self.runs()
        if len(names) > 1:
            self.levels = [[], [self._merge(names)]]
        return self.spark.table(self.runs()[0])

    def close(self) -> None:
        """Remove all runs."""
        self._remove(self.runs())
        self.levels = [[]]


def text_key(text_col: str) -> Column:
    """A digest of a row's text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def line_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """``(doc_id, key, h)``: one row per row (by its id and its text's digest) and distinct line key of enough code points."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    key = lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), _UPPER, _LOWER)
    keys = F.array_distinct(F.filter(F.transform(lines, key), lambda k: F.length(k) >= min_chars))
    return docs.select("doc_id", text_key(text_col).alias("key"), F.explode(keys).alias("line")).select("doc_id", "key", F.unhex(F.md5("line")).alias("h"))


def dedup_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with shared lines removed, plus ``n_lines`` and ``n_dropped``.

    A line whose key (blanks stripped, A-Z lower-cased) has at least ``min_chars`` code points and
    occurs in at least ``min_docs`` documents stays only in the document of the largest id. Null
    text counts as one empty line and stays null-free (empty text); a null id counts as one
    document below all others; repeated rows of an id are one document and are cut alike. The
    other columns pass through; input columns named like a computed one are replaced.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts), reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, i).otherwise(batch)
    path = scratch(spark, "lines")
    line_keys(docs, text_col, min_chars).withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.BinaryType()), T.StructField("h", T.BinaryType()), T.StructField("batch", T.IntegerType())])).parquet(path)

    store = LineRuns(spark, min_docs, fanout)
    for i in range(len(cuts) + 1):
        store.add(lines.filter(F.col("batch") == i).select("doc_id", "h"))
    # written first, so that the join's two sides are both dealt by it and a very common line can be split
    shared = stored(store.compacted().filter(F.col("n_docs") >= min_docs).select("h", "max_doc"), "shared-lines")
    store.close()
    drops = lines.join(shared.hint("merge"), "h").filter(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).select("doc_id", "key", "h").distinct()
    # a list holds lines of one text, however many rows have its id
    drops = drops.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__of")).agg(F.collect_list("h").alias("__drops"))
    kept = without(docs, ["n_lines", "n_dropped", "__key"]).columns
    joined = docs.select(*kept, text_key(text_col).alias("__key")).join(drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left").drop("__id", "__of", "__key")
    schema = T.StructType([*[docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in kept], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            texts, totals, dropped = [], [], []
            for text, gone in zip(b.column(text_col).to_pylist(), b.column("__drops").to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                out = text
                left = n
                if gone:
                    gone = set(gone)
                    good = [x for x in text.split("\n") if len(k := x.strip(BLANKS)) < min_chars or hashlib.md5(k.translate(_FOLD).encode()).digest() not in gone]
                    out, left = "\n".join(good), len(good)
                texts.append(out)
                totals.append(n)
                dropped.append(n - left)
            made = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(f.name, None) if f.name in made else b.column(f.name) for f in schema], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents without their shared lines, in the input's columns; ``n_chars``, if there, follows the text.

    Null text becomes empty, all documents stay (a text may become empty); null ids and repeated
    rows as in :func:`dedup_lines`. Columns of any name pass through.
    """
    plain = numbered(docs).withColumnsRenamed({f"c{docs.columns.index(c)}": c for c in ("doc_id", "text")})
    out = dedup_lines(plain)
    made = {"n_chars": F.length("text")}
    return out.select(*[made.get(c, F.col(x)).cast(docs.schema[c].dataType).alias(c) for c, x in zip(docs.columns, plain.columns, strict=True)])
