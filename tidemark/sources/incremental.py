"""Feature stages that follow their input: only chunks that see a change are computed again.

A stage is a folder of input rows and of results by chunk of time and generation, and a manifest
of versions. The manifest has, for each chunk, its generations, its summary and a digest of the
state that it was passed with. After new or corrected rows the touched chunks are summarised anew,
all summaries are folded (no rows are read for that), and what is passed again are the touched chunks and
those whose state has another digest. The next version of the manifest swaps all of it in at
once; readers of earlier versions are not disturbed.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scan import Scan, chunk_of, passed, states, summaries
from tidemark.sources.csv_bars import exists


def feed_digest(value: Any, into: Any) -> None:
    """Feed a state to a digest by its values, whatever objects hold them."""
    if is_dataclass(value):
        value = [getattr(value, f.name) for f in fields(value)]
    if isinstance(value, np.ndarray):
        into.update(b"a" + str(value.dtype).encode() + str(value.shape).encode() + np.ascontiguousarray(value).tobytes())
    elif isinstance(value, dict):
        into.update(b"d%d" % len(value))
        for k in sorted(value, key=repr):
            feed_digest(k, into)
            feed_digest(value[k], into)
    elif isinstance(value, (list, tuple)):
        into.update(b"l%d" % len(value))
        for x in value:
            feed_digest(x, into)
    elif isinstance(value, (bool, np.bool_, int, float, np.number)):
        into.update(b"n" + repr(float(value)).encode())
    else:
        into.update(b"o" + repr(value).encode())


@dataclass
class Changes:
    """What an update did: version, chunks touched by new rows, chunks passed again, chunks in all."""

    version: int
    touched: int
    passed: int
    chunks: int


class Stage:
    """The results of a scan over rows ``(symbol, ts, ...)`` that grow and are corrected.

    root: folder in a shared store. schema: of the rows. scan, made: the scan and the columns that it
    gives. width, size: of a chunk (``size`` bars of ``width``). alike: what of a state and of what a chunk
    is told its results depend on; positions that only number the rows can be taken out. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, scan: Scan, made: list[T.StructField], width: str, size: int, alike: Callable[[Any], Any] = lambda told: told):
        self.spark, self.root, self.schema, self.scan, self.made, self.width, self.size, self.alike = spark, root.rstrip("/"), schema, scan, made, width, size, alike
        self.keys = [T.StructField("gen", T.IntegerType()), T.StructField("part", T.StringType())]
        chunk = spark.createDataFrame([], schema).select("symbol", chunk_of("ts", width, size).alias("chunk")).schema
        self.manifest_schema = T.StructType([*chunk.fields, T.StructField("part", T.StringType()), T.StructField("rows_gen", T.IntegerType()), T.StructField("gen", T.IntegerType()), T.StructField("said", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("version", T.IntegerType())])

    def version(self) -> int:
        """The version that counts, 0 before the first."""
        if not exists(self.spark, f"{self.root}/manifest"):
            return 0
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.root}/manifest").agg(F.max("version")).first()[0] or 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """``(symbol, chunk, part, rows_gen, gen, said, digest)`` of a version."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], self.manifest_schema).drop("version")
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.root}/manifest").filter(F.col("version") == at).drop("version")

    def _table(self, name: str, columns: list[T.StructField]) -> DataFrame:
        path, schema = f"{self.root}/{name}", T.StructType([*columns, *self.keys])
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _of(self, name: str, columns: list[T.StructField], wanted: DataFrame) -> DataFrame:
        """Rows of a table that belong to ``(symbol, chunk, part, gen)``: the folders of generation and part are picked before they are read."""
        asked = wanted.select("symbol", "chunk", "part", "gen")
        folders = [(r["gen"], r["part"]) for r in asked.select("gen", "part").distinct().limit(MANY + 1).collect()]
        rows = self._table(name, columns)
        if len(folders) <= MANY:  # else the join prunes what it can
            rows = rows.filter(F.concat_ws("/", "gen", "part").isin([f"{g}/{p}" for g, p in folders]))
        same = [F.col("a.symbol").eqNullSafe(F.col("b.symbol")), F.col("a.part") == F.col("b.part"), F.col("a.gen") == F.col("b.gen")]
        return rows.alias("a").join(asked.alias("b"), same).select(*[F.col(f"a.{c.name}").alias(c.name) for c in columns], F.col("b.chunk").alias("chunk"))

    def read(self, version: int | None = None) -> DataFrame:
        """The results of a version, by default the latest."""
        return self._of("results", [*self.schema.fields, *self.made], self.manifest(version)).drop("chunk")

    def _placed(self, rows: DataFrame) -> DataFrame:
        placed = rows.select(*self.schema.names).withColumn("chunk", chunk_of("ts", self.width, self.size))
        return placed.withColumn("part", F.date_format("chunk", "yyyyMMddHHmmss"))

    def _keyed(self, told: DataFrame) -> DataFrame:
        """States with their digests."""
        alike = self.alike

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for state in batch.column("told"):
                    digest = hashlib.blake2b(digest_size=16)
                    feed_digest(alike(pickle.loads(state.as_py())), digest)
                    made.append(digest.digest())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "digest"])

        return told.mapInArrow(run, T.StructType([*told.schema.fields, T.StructField("digest", T.BinaryType())]))

    def update(self, delta: DataFrame) -> Changes:
        """Take in rows: new ones, and those of a time that is there already, which they replace.

        Of several rows of one symbol and time in ``delta`` one is taken. Rows that change nothing
        still touch their chunk. An empty ``delta`` changes nothing.
        """
        before = self.version()
        gen, old = before + 1, self.manifest(before)
        placed = self._placed(delta).persist()
        touched = placed.select("symbol", "chunk", "part").distinct().persist()
        n_touched = touched.count()
        if not n_touched:
            placed.unpersist(), touched.unpersist()
            return Changes(before, 0, 0, old.count())
        on = lambda a, b: [F.col(f"{a}.symbol").eqNullSafe(F.col(f"{b}.symbol")), F.col(f"{a}.part") == F.col(f"{b}.part")]
        held = old.alias("m").join(touched.alias("t"), on("m", "t"), "left_semi").select("symbol", "chunk", "part", F.col("rows_gen").alias("gen"))
        both = self._of("rows", self.schema.fields, held).withColumn("__new", F.lit(0)).unionByName(placed.drop("part").withColumn("__new", F.lit(1)))
        newest = Window.partitionBy("symbol", "chunk", "ts").orderBy(F.col("__new").desc(), *[F.col(c).desc() for c in self.schema.names if c not in ("symbol", "ts")])
        merged = both.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank", "__new")
        out = merged.withColumns({"gen": F.lit(gen), "part": F.date_format("chunk", "yyyyMMddHHmmss")}).drop("chunk")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", "part").parquet(f"{self.root}/rows")
        now = touched.withColumn("gen", F.lit(gen))
        fresh = summaries(self._of("rows", self.schema.fields, now), self.scan)
        stays = old.alias("m").join(touched.alias("t"), on("m", "t"), "left_anti")
        said = stays.select("symbol", "chunk", "said").unionByName(fresh).persist()
        told = self._keyed(states(said, self.scan)).withColumn("part", F.date_format("chunk", "yyyyMMddHHmmss")).persist()
        same = told.alias("n").join(old.alias("m"), on("n", "m"), "left").join(touched.withColumn("hit", F.lit(True)).alias("t"), on("n", "t"), "left")
        plan = same.select(
            "n.symbol", "n.chunk", "n.part", "n.told", "n.digest", F.when(F.col("t.hit"), F.lit(gen)).otherwise(F.col("m.rows_gen")).alias("rows_gen"),
            (F.coalesce("t.hit", F.lit(False)) | F.coalesce(F.col("m.digest") != F.col("n.digest"), F.lit(True))).alias("again"), F.col("m.gen").alias("gen_before"),
        ).persist()
        again = plan.filter("again")
        rows = self._of("rows", self.schema.fields, again.select("symbol", "chunk", "part", F.col("rows_gen").alias("gen")))
        results = passed(rows, again.select("symbol", "chunk", "told"), self.scan, self.made)
        results = results.withColumns({"gen": F.lit(gen), "part": F.date_format(chunk_of("ts", self.width, self.size), "yyyyMMddHHmmss")})
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", "part").parquet(f"{self.root}/results")
        swapped = plan.alias("p").join(said.alias("s"), [F.col("p.symbol").eqNullSafe(F.col("s.symbol")), F.col("p.chunk") == F.col("s.chunk")])
        swapped = swapped.select("p.symbol", "p.chunk", "p.part", "p.rows_gen", F.when(F.col("again"), F.lit(gen)).otherwise(F.col("gen_before")).alias("gen"), "s.said", "p.digest")
        swapped.withColumn("version", F.lit(gen)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.root}/manifest")
        one = plan.agg(F.count("*"), F.count_if("again")).first()
        for frame in (placed, touched, said, told, plan):
            frame.unpersist()
        return Changes(gen, n_touched, one[1], one[0])


#: Folders that are named to the reader one by one.
MANY = 1000
