"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash says so. Spark joins on the chunk digests choose one
owner per digest; the store keeps a chunk's bytes with its owner alone, and every payload's
ordered chunk list. Reading back fetches the bytes of shared chunks from their owners, checks
each chunk's digest, and puts payloads together. Texts become payloads of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import remove_path, scratch, slices, stored, table

UNIT = 64
MAGIC = b"TMC1"


@dataclass(frozen=True)
class ChunkParams:
    """least, most: bytes of a chunk. bits: a cut is taken where so many hash bits are 0. level: of zstd.
    flag_bits, most_flag_bits: bounds of the size of the bit map of rows with shared chunks, as powers of two
    (sixteen bits for each such row between them); it only decides which rows are joined, and false hits are harmless."""

    least: int = 2048
    most: int = 16384
    bits: int = 12
    level: int = 9
    flag_bits: int = 22
    most_flag_bits: int = 27


#: Gear table: 256 numbers from a seeded generator.
_GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over the last 32 bytes of gear[byte] << age, modulo 2^32, by doubling."""
    h = _GEAR[data]
    step = 1
    while step < 32:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
        step *= 2
    return h


def cut_points(size: int, marks: np.ndarray, p: ChunkParams) -> list[int]:
    """Ends of the chunks of a payload of ``size`` bytes; marks are positions after bytes where the hash asks for a cut."""
    ends, start = [], 0
    while size - start > p.least:
        at = np.searchsorted(marks, start + p.least)
        end = min(int(marks[at]) if at < len(marks) else size, start + p.most, size)
        ends.append(end)
        start = end
    if start < size or not ends:
        ends.append(size)
    return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of UNIT, and the bytes before padding."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _chunked(payloads: list[bytes], p: ChunkParams) -> list[list[bytes]]:
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.nonzero(gear_hashes(flat) >> np.uint32(32 - p.bits) == 0)[0] + 1
    out, at = [], 0
    for data in payloads:
        lo, hi = np.searchsorted(marks, [at, at + len(data)])
        ends = cut_points(len(data), marks[lo:hi] - at, p)
        out.append([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        at += len(data)
    return out


def _row_key(doc_id: int | None, payload: bytes) -> bytes:
    return _digest(_digest(payload) + repr(doc_id).encode())


STORE = T.StructType([
    T.StructField("rid", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.BinaryType())),
])


def _flags(rids: DataFrame, p: ChunkParams) -> np.ndarray:
    """The bit map of the row keys in ``rids``, in words of 32 bits: 2^most_flag_bits bits at most, whatever the input."""
    n = rids.count()
    bits = min(p.most_flag_bits, max(p.flag_bits, int(16 * n).bit_length()))
    bit = rids.select(F.conv(F.hex(F.substring("rid", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = bit.select(F.shiftright("b", 5).alias("w"), F.expr("shiftleft(1L, cast(b & 31 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[np.asarray(words["w"]).astype(np.int64)] = np.asarray(words["v"]).astype(np.uint32)
    return out


def _rows(docs: DataFrame, p: ChunkParams, flags: np.ndarray | None = None) -> DataFrame:
    """Chunk lists of all documents; with a bit map of row keys also the compressed bytes, and ``flagged``: whether the map has the row."""
    sent = docs.sparkSession.sparkContext.broadcast(flags)  # of bounded size
    with_data = flags is not None
    schema = T.StructType([*STORE.fields, T.StructField("flagged", T.BooleanType())] if with_data else STORE.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=p.level, write_checksum=False, write_content_size=True)
        for whole in batches:
            for part in slices(whole, "__text"):
                made = [payload_of(t) for t in part.column("__text").to_pylist()]
                keys = [_row_key(i, m[0]) for i, m in zip(part.column("doc_id").to_pylist(), made, strict=True)]
                chunks = _chunked([m[0] for m in made], p)
                cols = [
                    pa.array(keys, pa.binary()), part.column("doc_id"), pa.array([m[1] for m in made], pa.int64()),
                    pa.array([len(m[0]) for m in made], pa.int64()), pa.array([[_digest(c) for c in cs] for cs in chunks], pa.list_(pa.binary())), pa.array([[len(c) for c in cs] for cs in chunks], pa.list_(pa.int32())),
                ]
                if with_data:
                    at = np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64) & (32 * len(sent.value) - 1)
                    hit = (sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
                    cols += [pa.array([[packer.compress(c) for c in cs] for cs in chunks], pa.list_(pa.binary())), pa.array(hit)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return source.mapInArrow(run, schema)


@dataclass
class MediaStore:
    """A written chunk store: ``plain`` rows share nothing; ``rows`` have bytes where they own the chunk;
    ``requests`` say where shared chunks lie."""

    plain: DataFrame
    rows: DataFrame
    requests: DataFrame  # (owner, owner_pos, rid, pos): chunk pos of row rid lies with the owner


def write_media(docs: DataFrame, params: ChunkParams = ChunkParams()) -> MediaStore:
    """Store every document's payload once per distinct chunk.

    Null text is the empty text; null ids are carried. Repeated rows (same id and text) share
    their row key and are stored alike; equal texts of different ids share all chunks. Columns
    other than doc_id and text are not stored.
    """
    spark = docs.sparkSession
    lists = stored(_rows(docs, params).select("rid", F.posexplode("digests").alias("pos", "digest")).distinct(), "chunk-lists")
    # written first, so that the join can split a chunk that very many payloads share
    owners = stored(lists.groupBy("digest").agg(F.min(F.struct("rid", "pos")).alias("own"), F.count("*").alias("n")).filter("n > 1"), "chunk-owners")
    placed = lists.join(owners.hint("merge"), "digest").filter("rid <> own.rid or pos <> own.pos")
    requests = stored(placed.select(F.col("own.rid").alias("owner"), F.col("own.pos").alias("owner_pos"), "rid", "pos"), "chunk-requests")
    flags = _flags(requests.select("rid").unionAll(requests.select(F.col("owner").alias("rid"))), params)
    path = scratch(spark, "media")
    _rows(docs, params, flags).write.partitionBy("flagged").option("compression", "none").parquet(path)
    written = spark.read.schema(T.StructType([*STORE.fields, T.StructField("flagged", T.BooleanType())])).parquet(path)
    # rows that share chunks are written again without the bytes that lie with others
    shared = requests.groupBy("rid").agg(F.collect_set("pos").alias("shared"))
    own_only = F.transform("data", lambda d, i: F.when(F.coalesce(F.array_contains("shared", i), F.lit(False)), F.lit(None)).otherwise(d))
    rows = stored(written.filter("flagged").join(shared.hint("merge"), "rid", "left").select(*STORE.names[:-1], own_only.alias("data")), "media-shared")
    remove_path(spark, f"{path}/flagged=true")
    return MediaStore(written.filter("not flagged").drop("flagged"), rows, requests)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def read_media(store: MediaStore, with_payload: bool = False) -> DataFrame:
    """Read every stored payload back, check it, and compute features; a chunk that fails its digest raises.

    media_bytes, media_sha256: the stored form, i.e. the chunk list (magic, count, then size and
    digest of each chunk) followed by the stored chunks. feature: number of chunks, distinct byte
    values, mean, and entropy of the samples.
    """
    asked = store.requests.select("owner", "owner_pos").distinct()
    held = store.rows.join(asked.groupBy(F.col("owner").alias("rid")).agg(F.collect_list("owner_pos").alias("asked")).hint("merge"), "rid")
    lent = held.select(F.col("rid").alias("owner"), F.posexplode("data").alias("owner_pos", "bytes"), "asked").filter(F.array_contains("asked", F.col("owner_pos")))
    # written first, so that the join can split a chunk that very many payloads ask for
    lent = stored(lent.select("owner", "owner_pos", "bytes").dropDuplicates(["owner", "owner_pos"]), "media-lent")
    fetched = store.requests.join(lent.hint("merge"), ["owner", "owner_pos"])
    fetched = fetched.groupBy("rid").agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    joined = store.rows.join(fetched.hint("merge"), "rid", "left")
    alone = store.plain.withColumn("fetched", F.lit(None).cast("array<struct<pos:int,bytes:binary>>"))
    schema = T.StructType([*RESULT.fields, T.StructField("payload", T.BinaryType())]) if with_payload else RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for row in b.to_pylist():
                data = list(row["data"])
                for f in row["fetched"] or ():
                    data[f["pos"]] = f["bytes"]
                parts = []
                for d, size, digest in zip(data, row["sizes"], row["digests"], strict=True):
                    part = opener.decompress(d, max_output_size=size)
                    if len(part) != size or _digest(part) != digest:
                        raise ValueError(f"a chunk of document {row['doc_id']} doesn't match its digest")
                    parts.append(part)
                payload = b"".join(parts)
                if len(payload) != row["payload_bytes"]:
                    raise ValueError(f"the payload of document {row['doc_id']} has a wrong size")
                media = hashlib.sha256(head := MAGIC + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", s) + g for s, g in zip(row["sizes"], row["digests"], strict=True)))
                for d in data:
                    media.update(d)
                samples = np.frombuffer(payload, np.uint8)
                counts = np.bincount(samples, minlength=256)
                share = counts[counts > 0] / len(samples)
                feature = f"chunks={len(parts)};values={int((counts > 0).sum())};mean={samples.mean():.6f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.6f}"
                made = {"doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                        "media_bytes": len(head) + sum(map(len, data)), "media_sha256": media.hexdigest(), "feature": feature}
                out.append(made | {"payload": payload} if with_payload else made)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(schema)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(schema.names, kinds, strict=True))))

    return alone.mapInArrow(run, schema).unionAll(joined.select(*alone.columns).mapInArrow(run, schema))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored, read back and described."""
    return read_media(write_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
