"""Operator 4: exact top-k search in Hamming space by incremental multi-index hashing.

Codes are cut into m segments of about log2(rows) bits, and every segment value is indexed. Searches go in
rounds: round r probes the segment values at distance exactly r, a candidate counts where it is found first
(so none comes twice), its full distance is held against the query's last wanted distance so far, and a query ends once its last wanted distance is at
most m * (r + 1) - 1, for a code that near differs in some segment by at most r bits. The values at distance r of a
segment come from flipping r of its bits, or, where that would give more values than the segment has in the index, from
holding the query's segment against these distinct values: blocks of queries meet tiles of values, and only values at
distance r go on. Both give the same probes, so all neighbours are found and verified through the segments' lists. Of
rows with one code only the k + 1 least ids are indexed, and queries of one code are searched once, so a vector that
many rows share costs no more than others.

Defined cases: bit i of a code is set where component i of the vector is above zero (null and NaN are not; a
vector of more than 64 components is an error); rows with a null id or vector take no part; rows that share an id
and a code count once, and those that share an id alone are told apart by their codes, none the neighbour of
another; ties go to the smaller id; fewer than k other rows give them all; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Tables, materialise, shuffle_width, small_batches

BITS = 64
#: Distinct values of a segment that a tile holds.
TILE = 65_536


def sign_code(vector) -> F.Column:
    """The signs of a vector of up to 64 components as a 64-bit integer."""
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) <= BITS, code).otherwise(F.raise_error("a vector has more than 64 components").cast("long"))


def widths(rows: int) -> list[int]:
    """Segment widths: about log2(rows) bits each, 16 at least."""
    m = max(1, round(BITS / max(16.0, log2(max(rows, 2)))))
    return [BITS // m + (j < BITS % m) for j in range(m)]


def segment(code, at: int, width: int):
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def probes_at(asked: DataFrame, r: int, tasks: int) -> DataFrame:
    """query, bound, j and key of all segment values at distance r; asked: query, bound, j, width, value."""
    rows = asked.where(F.col("width") >= r).repartition(tasks, "query", "j").withColumns({"mask": F.lit(0).cast("long"), "top": F.lit(-1)})
    for k in range(r):  # one more bit, above those that are set
        rows = rows.withColumn("top", F.explode(F.sequence(F.col("top") + 1, F.col("width") - (r - k))))
        rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))))
    return rows.select("query", "bound", "j", F.call_function("shiftleft", F.col("j").cast("long"), F.lit(40)).bitwiseOR(F.col("value").bitwiseXOR(F.col("mask"))).alias("key"))


def held_against(asked: DataFrame, values: DataFrame, tiles: int, r: int, queries: int, block: int = 4096) -> DataFrame:
    """The same for segments whose distinct values are fewer: those at distance r among values(j, tile, held), by blocks of queries and tiles of values."""
    blocks = max(1, -(-queries // block))
    packed = asked.groupBy("j", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "bound", "value")).alias("asked"))
    met = packed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(values, ["j", "tile"]).select("j", "asked", "held")

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                j, structs, held = b.column(0)[k].as_py(), b.column(1)[k].values, b.column(2)[k].values.to_numpy()
                query, bound, value = (structs.field(n).to_numpy() for n in ("query", "bound", "value"))
                for at in range(0, len(query), 256):
                    near = np.bitwise_count((value[at : at + 256, None] ^ held[None]).view(np.uint64)) == r
                    q, v = np.nonzero(near)
                    yield pa.record_batch([pa.array(query[at + q]), pa.array(bound[at + q], pa.int32()), pa.array(np.full(len(q), j), pa.int32()), pa.array((j << 40) | held[v])], ["query", "bound", "j", "key"])

    return met.mapInArrow(compare, "query long, bound int, j int, key long")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, rounds: list[int] | None = None) -> DataFrame:
    """rows and queries: vec_id, code. Gives query_id, neighbor_id, distance and rank of the k nearest rows of each query. rounds: takes the number of codes whose search each round ended."""
    spark = ship(rows.sparkSession)
    small_batches(spark)
    want = k + 1  # one may be the query itself
    least = Window.partitionBy("code").orderBy("vec_id")
    t, tasks = Tables(spark), shuffle_width(spark)
    index = t.write(rows.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= want).select("code", "vec_id"))
    held = index.count()
    cuts = widths(held)
    starts = [sum(cuts[:j]) for j in range(len(cuts))]
    parts = F.array(*(F.lit(j << 40).cast("long").bitwiseOR(segment(F.col("code"), a, w)) for j, (a, w) in enumerate(zip(starts, cuts, strict=True))))
    buckets = t.write(index.select("code", "vec_id", F.explode(parts).alias("key")))
    active = t.write(queries.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS)))
    asked = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(w).alias("width"), segment(F.col("query"), a, w).alias("value")) for j, (a, w) in enumerate(zip(starts, cuts, strict=True))))
    rank = Window.partitionBy("query").orderBy("distance", "vec_id")
    best, done = None, []
    low = F.lit((1 << 40) - 1).cast("long")
    kinds = buckets.select(F.shiftright("key", 40).cast("int").alias("j"), F.col("key").bitwiseAND(low).alias("value")).distinct()
    kinds = t.write(kinds)
    sizes = {row["j"]: row["n"] for row in kinds.groupBy("j").agg(F.count("*").alias("n")).collect()}  # a row for each segment
    tiles = max(1, -(-max(sizes.values(), default=1) // TILE))
    values = t.write(kinds.groupBy("j", F.pmod(F.xxhash64("value"), F.lit(tiles)).cast("int").alias("tile")).agg(F.collect_list("value").alias("held")))
    t.drop(kinds)
    for r in range(max(cuts) + 1):
        segments = active.select("query", "bound", F.explode(asked).alias("s")).select("query", "bound", "s.*")
        few = [j for j, w in enumerate(cuts) if comb(w, r) > sizes.get(j, 0)]  # the segment has fewer values than there would be flips
        probes = probes_at(segments.where(~F.col("j").isin(few)), r, tasks)
        if few:
            probes = probes.unionByName(held_against(segments.where(F.col("j").isin(few)), values, tiles, r, active.count()))
        gap = F.col("query").bitwiseXOR(F.col("code"))
        first = F.bit_count(gap) <= F.col("bound")  # and no earlier segment is as near, no later one nearer
        for i, (a, w) in enumerate(zip(starts, cuts, strict=True)):
            d = F.bit_count(segment(gap, a, w))
            first = first & F.when(F.col("j") > i, d > r).when(F.col("j") < i, d >= r).otherwise(True)
        found = probes.join(buckets.hint("merge"), "key")  # never broadcast: how many probes there are, no estimate knows
        found = found.where(first).select("query", "vec_id", F.bit_count(gap).alias("distance"))
        both = found if best is None else found.unionByName(best)
        ranked = t.write(both.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= want).drop("n"))
        near = t.write(ranked.groupBy("query").agg(F.max("distance").alias("last"), F.count("*").alias("n")).where(F.col("n") >= min(want, held)).select("query", "last"))
        over = near.where(F.col("last") <= len(cuts) * (r + 1) - 1).select("query")
        done.append(t.write(ranked.join(over, "query", "left_semi")))
        left = t.write(active.join(over, "query", "left_anti").join(near, "query", "left").select("query", F.least("bound", "last").alias("bound")))
        t.drop(active, near, *([best] if best else []))
        active, best = left, t.write(ranked.join(left.select("query"), "query", "left_semi"))
        t.drop(ranked)
        if rounds is not None:
            rounds.append(done[-1].select("query").distinct().count())
        if active.isEmpty():
            break
    t.drop(index, buckets, values)
    done = reduce(DataFrame.unionByName, done)
    per = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).distinct().join(done, "query").where("query_id <> vec_id")
    out = out.select("query_id", F.col("vec_id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"))
    return out.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)


def codes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    kept = vectors.where(vectors[id_col].isNotNull() & vectors[vector_col].isNotNull())
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col)).alias("code"))


def op4_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(codes_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=10)


OP4_SQL = """
WITH halves AS (
  SELECT vec_id,
         CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS lo,
         CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS hi
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id, CAST(bit_count(xor(q.lo, x.lo)) + bit_count(xor(q.hi, x.hi)) AS INTEGER) AS distance
  FROM halves q JOIN halves x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 10
"""
