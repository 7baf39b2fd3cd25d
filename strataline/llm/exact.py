"""Operator 1: exact deduplication by a Golomb-coded fingerprint exchange.

Each task reads its rows once, normalises and hashes the texts, and sends every owner of a fingerprint range
its sorted distinct fingerprints, Golomb coded. Owners merge what they get and answer with one bitmap for
each message: the fingerprints seen elsewhere, or twice in the task itself. Rows whose bit is set are
suspects. Their ids go to all tasks as a bitmap of bounded size, so that a second reading of the rows shuffles
only texts of suspects (and of a few ids that share a bit), which are compared byte for byte by grouping on the
text itself; copies collapse before that exchange. All other rows are unique.

Defined cases: texts are equal when their bytes are after lower-casing A-Z; null counts as empty; of equal
texts the row with the largest doc_id stays, a null doc_id counting as the smallest; of rows that share
that doc_id too exactly one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, keyed, marked_by, pieces, shuffle_width

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a fingerprint: a share of about rows / 2**48 of the unique rows are suspected for nothing.
FINGERPRINT_BITS = 48
SENT = "rid long, doc_id long, sha string, block int, owner int, pos int, message binary"


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct values below span: their count, the parameter 2**r, remainders, then unary quotients of the gaps."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.int64(0)).astype(np.int64)
    r = max(0, int(span // n).bit_length() - 1)
    low = ((gaps[:, None] >> np.arange(r)) & 1).astype(np.uint8)
    quotients = gaps >> r
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    return np.array([n], "<u4").tobytes() + bytes([r]) + np.packbits(np.concatenate([low.ravel(), unary])).tobytes()


def golomb_decode(message: bytes) -> np.ndarray:
    if not message:
        return np.zeros(0, np.int64)
    n, r = int(np.frombuffer(message, "<u4", 1)[0]), message[4]
    bits = np.unpackbits(np.frombuffer(message, np.uint8, offset=5))
    low = bits[: n * r].reshape(n, r).astype(np.int64) @ (np.int64(1) << np.arange(r, dtype=np.int64)) if r else np.zeros(n, np.int64)
    ends = np.flatnonzero(bits[n * r :])[:n]
    return np.cumsum((np.diff(ends, prepend=-1) - 1 << r) + low)


def send(owners: int):
    """Rows with their place in the exchange, then one message for each owner."""
    span = -(-(1 << FINGERPRINT_BITS) // owners)

    def run(batches):
        block = TaskContext.get().partitionId()
        ids, nulls, held = [], [], bytearray()  # copies, for a column of a batch keeps its texts alive; 32 bytes of digest for each row
        for b in pieces(batches):
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).copy())
            nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False).copy())
            for text in b.column(1).cast(pa.binary()):
                held += sha256(text.as_py().translate(LOWER)).digest()
        if not held:
            return
        ids, nulls = np.concatenate(ids), np.concatenate(nulls)
        prints = (np.frombuffer(held, ">u8").reshape(-1, 4)[:, 0] >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.int64)
        distinct, back, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = distinct // span
        first = np.searchsorted(owner, np.arange(owners + 1))
        pos = np.arange(len(distinct)) - first[owner]
        names, types = [x.split()[0] for x in SENT.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for at in range(0, len(ids), 10_000):
            k = slice(at, at + 10_000)
            own = pa.array(ids[k], pa.int64(), mask=nulls[k])
            n = len(own)
            shas = [held[32 * j : 32 * j + 32].hex() for j in range(at, at + n)]
            cols = [(block << 33) + np.arange(at, at + n), shas, np.full(n, block), owner[back[k]], pos[back[k]], [None] * n]
            made = [pa.array(c, t) for c, t in zip(cols, types[:1] + types[2:], strict=True)]
            yield pa.record_batch([made[0], own, *made[1:]], names)
        for o in np.unique(owner):
            part = slice(first[o], first[o + 1])
            twice = np.packbits(counts[part] > 1).tobytes()  # seen twice in the task itself
            message = len(twice).to_bytes(4, "little") + twice + golomb_encode(distinct[part] - o * span, span)
            yield pa.record_batch([pa.array([c], t) for c, t in zip([None, None, None, block, int(o), None, message], types, strict=True)], names)

    return run


def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The owner's side: all messages of a range -> a bitmap for each block."""
    blocks, messages = table.column("block").to_pylist(), table.column("message").to_pylist()
    twice, values = [], []
    for m in messages:
        n = int.from_bytes(m[:4], "little")
        values.append(golomb_decode(m[4 + n :]))
        twice.append(np.unpackbits(np.frombuffer(m, np.uint8, n, 4))[: len(values[-1])].astype(bool))
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    seen = np.zeros(len(every), bool)
    seen[order[1:]] |= same
    seen[order[:-1]] |= same
    ends = np.cumsum([len(v) for v in values])
    maps = [np.packbits(seen[e - len(v) : e] | t).tobytes() for v, t, e in zip(values, twice, ends, strict=True)]
    return pa.table({"block": pa.array(blocks, pa.int32()), "owner": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "bitmap": pa.array(maps, pa.binary())})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    source = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    t = Tables(spark)
    sent = t.write(source.mapInArrow(send(owners or shuffle_width(spark)), SENT))
    rows = sent.where("message is null").drop("message")
    bitmaps = sent.where("message is not null").select("block", "owner", "message").groupBy("owner").applyInArrow(answer, "block int, owner int, bitmap binary")
    byte = F.conv(F.hex(F.expr("substring(bitmap, pos div 8 + 1, 1)")), 16, 10).cast("int")
    marked = t.write(rows.join(bitmaps, ["block", "owner"]).select("rid", "doc_id", "sha", (byte.bitwiseAND(F.expr("shiftright(128, cast(pos % 8 as int))")) != 0).alias("suspect")))
    t.drop(sent)
    suspects = t.write(marked.where("suspect").select("rid", "doc_id", "sha"))
    held = suspects.select(F.col("doc_id").alias("held_id"), F.col("sha").alias("held_sha")).distinct()
    texts = marked_by(source, "doc_id", suspects, "doc_id", "some").where("some").select("doc_id", F.translate("text", UPPER_LETTERS, LOWER_LETTERS).alias("body"))
    texts = texts.withColumn("sha", F.sha2(F.col("body").cast("binary"), 256)).join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("sha") == F.col("held_sha")), "left_semi")
    bodies = texts.groupBy("body").agg(F.first("sha").alias("sha"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).groupBy("sha").agg(F.count("*").alias("n_bodies"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    one = F.when(F.col("n_bodies") == 1, F.col("group_size")).otherwise(F.raise_error("two texts share a SHA-256").cast("long"))
    stay = suspects.groupBy("sha").agg(F.max(F.struct(F.col("doc_id"), (-F.col("rid")).alias("order"))).alias("stay"))
    classes = t.write(bodies.select("sha", one.alias("group_size"), "keep_id").join(stay, "sha"))  # so that the next join's sides are plain exchanges, which Spark splits where skewed
    found = suspects.join(classes, "sha").select("doc_id", "keep_id", "group_size", (-F.col("rid") == F.col("stay.order")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(found)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_LETTERS}', '{LOWER_LETTERS}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
