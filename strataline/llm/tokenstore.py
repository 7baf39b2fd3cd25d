"""Operator 2: binary token-id files with a shared zstandard dictionary.

A store is a folder with two Parquet tables, so any file system that Spark writes can hold it:

* ``dictionary``: one row (hash, width, bytes), the zstandard dictionary trained on serialised id arrays;
* ``shards``: rows of at most about ``shard_bytes`` of frames. A shard names its range of ids, the hash of
  its dictionary and the ids before it in its range part, and holds an index (doc_ids, token counts, end
  offsets of the frames) and the frames: each document's ids, compressed separately, so that one short
  document is read by seeking to its frame alone.

Shards follow ascending doc_id. Range bounds come from quantiles of doc_id alone, so texts are encoded once
and only compressed frames are shuffled. Null doc_ids come first, rows that share a doc_id stand together
(ordered by their frames), null texts are empty, an empty table makes a store without shards.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, pieces, shared_dir, shuffle_width
from .tokens import encoder

FRAMES = "doc_id long, part int, n_tokens long, frame binary"
SHARDS = "part int, seq int, first_id long, last_id long, n_docs int, n_tokens long, tokens_before long, dict_hash string, doc_ids binary, has_id binary, counts binary, ends binary, frames binary"
READ = "doc_id long, start long, n_tokens long, ids binary"
LEVEL = 3


@lru_cache(maxsize=4)
def codec(dictionary: bytes):
    """(compressor, decompressor); without a dictionary for tables too small to train one."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kind = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False, write_dict_id=False, **kind), zstandard.ZstdDecompressor(**kind)


def dict_hash(dictionary: bytes) -> str:
    return sha256(dictionary).hexdigest()[:16]


def train(docs: DataFrame, vocab: str | None, width: int, sample_docs: int, sample_chars: int, dict_bytes: int) -> bytes:
    """A dictionary from the id arrays of at most sample_docs documents: those of at most sample_chars characters whose hashed ids are least."""
    picked = [r[0] for r in docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]

    def run(batches):
        for b in pieces(batches):
            yield pa.record_batch([pa.array([np.frombuffer(encoder(vocab).encode(t), "<u4").astype(f"<u{width}").tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["ids"])

    rows = docs.where(F.col("doc_id").isin(picked) & (F.length("text") <= sample_chars)).select("text").limit(2 * sample_docs).mapInArrow(run, "ids binary").collect()
    samples = [bytes(r[0]) for r in rows if len(r[0]) >= 16]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def to_frames(vocab: str | None, end_id: int, width: int, dictionary: bytes, bounds: list[int]):
    def run(batches):
        enc, end = encoder(vocab), np.array([end_id], "<u4").tobytes()
        pack = codec(dictionary)[0].compress
        for b in pieces(batches):
            out = ([], [], [], [])
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, "<u4")
                row = (i, 0 if i is None else bisect_right(bounds, i), len(ids), pack(ids.astype(f"<u{width}").tobytes()))
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "part", "n_tokens", "frame"])

    return run


def to_shards(shard_bytes: int, hash_: str):
    """Rows sorted by part and doc_id -> shards; the running count starts anew with each part."""

    def run(batches):
        part, seq, before, rows, size = None, 0, 0, [], 0

        def shard():
            ids = [r[0] for r in rows]
            known = [i for i in ids if i is not None]
            counts = np.array([r[1] for r in rows], "<i8")
            made = {
                "part": part, "seq": seq, "first_id": min(known, default=None), "last_id": max(known, default=None), "n_docs": len(rows), "n_tokens": int(counts.sum()), "tokens_before": before, "dict_hash": hash_,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "has_id": np.array([i is not None for i in ids], "u1").tobytes(), "counts": counts.tobytes(),
                "ends": np.cumsum([len(r[2]) for r in rows], dtype="<i8").tobytes(), "frames": b"".join(r[2] for r in rows),
            }
            return pa.RecordBatch.from_pylist([made], pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SHARDS.split(", "))]))

        for b in pieces(batches):
            for i, p, n, frame in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if rows and (p != part or size + len(frame) > shard_bytes):
                    made = shard()
                    seq, before = seq + 1, before + made.column("n_tokens")[0].as_py()
                    rows, size = [], 0
                    yield made
                if p != part:
                    part, seq, before = p, 0, 0
                rows.append((i, n, frame))
                size += len(frame)
        if rows:
            yield shard()

    return run


def write_store(docs: DataFrame, path: str, end_id: int = 2, vocab: str | None = None, parts: int | None = None, shard_bytes: int = 1 << 20, sample_docs: int = 1024, sample_chars: int = 50_000, dict_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs and write the store at path. sample_*: the bound of the rows that the dictionary is trained on."""
    docs = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    width = 2 if encoder(vocab).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = train(docs, vocab, width, sample_docs, sample_chars, dict_bytes)
    parts = parts or shuffle_width(spark)
    bounds = sorted({int(x) for x in docs.select("doc_id").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    frames = docs.mapInArrow(to_frames(vocab, end_id, width, dictionary, bounds), FRAMES)
    ordered = frames.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    ordered.mapInArrow(to_shards(shard_bytes, dict_hash(dictionary)), SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(dict_hash(dictionary), width, bytearray(dictionary))], "hash string, width int, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def opened(width: int, hash_: str, dictionary: bytes, bases: dict[int, int], only: int | None = None):
    def run(batches):
        unpack = codec(dictionary)[1].decompress
        for b in pieces(batches, 1):
            for s in b.to_pylist():
                if s["dict_hash"] != hash_:
                    raise ValueError(f"shard needs dictionary {s['dict_hash']}, found {hash_}")
                ids, has, counts, ends = (np.frombuffer(s[c], t) for c, t in (("doc_ids", "<i8"), ("has_id", "u1"), ("counts", "<i8"), ("ends", "<i8")))
                starts = bases[s["part"]] + s["tokens_before"] + np.cumsum(counts) - counts
                at = range(len(ids)) if only is None else np.flatnonzero((ids == only) & (has == 1))
                found = [np.frombuffer(unpack(s["frames"][ends[k - 1] if k else 0 : ends[k]]), f"<u{width}").astype("<u4").tobytes() for k in at]
                at = list(at)
                yield pa.record_batch([pa.array(ids[at], pa.int64(), mask=has[at] == 0), pa.array(starts[at]), pa.array(counts[at]), pa.array(found, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_store(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32 as bytes) of every document, or of one, for which only its shards' frames are opened."""
    hash_, width, dictionary = spark.read.parquet(f"{path}/dictionary").head()
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row for each range part
    bases, total = {}, 0
    for part in sorted(sums):
        bases[part], total = total, total + sums[part]
    if doc_id is not None:
        shards = shards.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return shards.mapInArrow(opened(width, hash_, bytes(dictionary), bases, doc_id), READ)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(documents(spark, sf_dir), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")

    def crc(batches):
        for b in pieces(batches):
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([zlib.crc32(x.as_buffer()) for x in b.column(3)], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_store(spark, path).mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
