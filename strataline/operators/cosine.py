"""Exact cosine join of vectors, with pivots that rule out pairs of tiles and rows before any product.

Angles between vectors obey the triangle inequality: where two vectors' angles to a pivot differ by more than the
widest angle that still matches, the two do not match. Vectors go to their nearest pivot, and those of a pivot into
rings of like angle, so a tile is a ring of a pivot, cut further where it is too large. A tile keeps its least and
largest angle to every pivot. Pairs of tiles whose ranges are too far apart at some pivot are never formed; in a pair
that is, rows too far from the other tile's ranges are left out of the product. Pivots decide on cost alone, so they
come from a bounded sample. A tile has a bounded number of bytes and is shuffled once for each tile that it meets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.storage import cut

SEMANTIC_THRESHOLD = 0.48
#: Pivots, and the vectors among which they are chosen.
PIVOTS, SAMPLE = 16, 1024
#: Rings of a pivot, and bytes and rows of a tile.
RINGS, TILE_BYTES, TILE_ROWS = 32, 1 << 25, 16_384
#: Rows of a product at once.
STEP = 2048
#: Angles are compared with so much room for rounding.
ROOM = 1e-6
PLACED = "id long, file string, v array<double>, angles array<double>, near int, own double"
TILE = "tile int, ids binary, files array<string>, matrix binary, angles binary, low array<double>, high array<double>"
MATCH = "id_a long, id_b long, similarity double"


def normalised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors of length 1; those of length 0 stay zero, components that are no finite numbers become 0."""
    clean = F.transform(F.col(vector), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("double")).otherwise(0.0))
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(vector, clean).withColumn("_norm", norm).withColumn(vector, F.when(F.col("_norm") > 0, F.transform(vector, lambda x: x / F.col("_norm"))).otherwise(F.col(vector))).drop("_norm")


def spread(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Different rows far from each other: each next one is the farthest from those before. Zero rows are no pivots, but where there are no others."""
    some = sample[(sample != 0).any(1)]
    sample = some if len(some) else sample
    kept, near = [0], sample @ sample[0]
    while len(kept) < most and near.min() < 1 - 1e-9:
        kept.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[kept[-1]])
        near[kept[-1]] = 1
    return sample[kept]


def angles_to(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def matrix_of(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def placed(unit: DataFrame, pivots: np.ndarray) -> DataFrame:
    """unit(id, file, v) with the angles to all pivots, the nearest pivot and the angle to it."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                angles = angles_to(matrix_of(b.column(2)), pivots)
                near = angles.argmin(1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1) * len(pivots), pa.int32()), pa.array(angles.ravel()))
                yield pa.record_batch([*b.columns, listed, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(angles)), near])], ["id", "file", "v", "angles", "near", "own"])

    return cut(unit.mapInArrow(run, PLACED))


def tiled(rows: DataFrame, most: int) -> DataFrame:
    """rows of `placed` in tiles of about `most` rows: rings of a pivot by quantiles, large ones cut by a hash of the id."""
    cuts = rows.groupBy("near").agg(F.percentile_approx("own", [k / RINGS for k in range(1, RINGS)]).alias("cuts"), F.count("*").alias("n"))
    wanted = F.least(F.lit(RINGS), F.ceil(F.col("n") / most)).cast("int")
    every = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda k: F.element_at("cuts", F.greatest(F.lit(1), F.floor(RINGS * k / wanted).cast("int"))))
    cuts = cuts.select("near", F.when(wanted > 1, every).otherwise(F.array().cast("array<double>")).alias("cuts"))  # a row for each pivot
    ring = F.size(F.filter("cuts", lambda c: c < F.col("own")))
    ringed = cut(rows.join(F.broadcast(cuts), "near").withColumn("ring", ring).drop("cuts"))
    sizes = ringed.groupBy("near", "ring").agg(F.count("*").alias("n")).orderBy("near", "ring").collect()  # at most PIVOTS * RINGS rows
    plan, first = [], 0
    for r in sizes:
        parts = -(-r["n"] // most)
        plan.append((r["near"], r["ring"], first, parts))
        first += parts
    plan = rows.sparkSession.createDataFrame(plan, "near int, ring int, first int, parts int")
    numbered = ringed.join(F.broadcast(plan), ["near", "ring"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        angles = matrix_of(table.column("angles"))
        out = [key[0].as_py(), table.column("id").to_numpy().astype("<i8").tobytes(), table.column("file").to_pylist(), matrix_of(table.column("v")).tobytes(), angles.tobytes(), angles.min(0).tolist(), angles.max(0).tolist()]
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], [c.split()[0] for c in TILE.split(", ")])

    return cut(numbered.select("tile", "id", "file", "v", "angles").groupBy("tile").applyInArrow(packed, TILE))


def meetings(tiles: DataFrame, widest: float) -> DataFrame:
    """a and b (a <= b) of the tiles whose ranges are near enough at every pivot."""
    ends = tiles.select("tile", "low", "high")
    count = tiles.count()
    a = ends.toDF("a", "low_a", "high_a").withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(count - 1))))
    met = a.join(ends.toDF("b", "low_b", "high_b"), "b")
    far = lambda low, high: F.exists(F.arrays_zip(low, high), lambda x: x[low] - x[high] > widest)
    return met.where(~far("low_a", "high_b") & ~far("low_b", "high_a")).select("a", "b")


def products(key: tuple[pa.Scalar, ...], table: pa.Table, threshold: float, widest: float) -> pa.Table:
    """The matches between the rows of one tile or two."""
    sides = []
    for k in np.argsort(table.column("tile").to_numpy()):
        ids = np.frombuffer(table.column("ids")[k].as_py(), "<i8")
        read = lambda name, k=k, n=len(ids): np.frombuffer(table.column(name)[k].as_py()).reshape(n, -1)
        sides.append((ids, np.array(table.column("files")[k].as_py(), object), read("matrix"), read("angles")))
    one, two = sides[0], sides[-1]
    if len(sides) > 1:
        near = lambda x, y: ((x[3] <= y[3].max(0) + widest) & (x[3] >= y[3].min(0) - widest)).all(1)
        one = tuple(p[near(one, two)] for p in one)
        two = tuple(p[near(two, one)] for p in two) if len(one[0]) else one
    out = []
    for at in range(0, len(one[0]), STEP):
        s = one[2][at : at + STEP] @ two[2].T
        i, j = np.nonzero(s >= threshold)
        ia, ib = one[0][at + i], two[0][j]
        keep = (one[1][at + i] != two[1][j]) & ((ia < ib) if len(sides) == 1 else (ia != ib))
        out.append((np.minimum(ia, ib)[keep], np.maximum(ia, ib)[keep], np.round(s[i, j][keep], 6)))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"id_a": pa.array(cols[0], pa.int64()), "id_b": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float64())})


def semantic_matches(vectors: DataFrame, threshold: float = SEMANTIC_THRESHOLD, id_col: str = "id", file_col: str = "path", vector: str = "embedding", rows: int | None = None, seen: list | None = None) -> DataFrame:
    """Pairs (id_a < id_b, of different files, similarity rounded to 6) whose cosine is at least the threshold; exact.

    Vectors of different length are an error; null ids and vectors take no part. rows: of a tile, by default what
    fits its bytes; seen: takes (pairs of tiles formed, all pairs of tiles).
    """
    spark = ship(vectors.sparkSession)
    unit = normalised(vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()), vector)
    unit = cut(unit.select(F.col(id_col).cast("long").alias("id"), F.col(file_col).cast("string").alias("file"), F.col(vector).alias("v")))
    sample = [r["v"] for r in unit.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], MATCH)
    length = len(sample[0])
    sample = [v for v in sample if len(v) == length]
    checked = unit.withColumn("v", F.when(F.size("v") == length, F.col("v")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>")))
    tiles = tiled(placed(checked, spread(np.array(sample))), rows or max(1, min(TILE_ROWS, TILE_BYTES // (8 * length))))
    widest = (math.acos(max(-1.0, min(1.0, threshold))) if threshold > -1 else math.pi) + ROOM
    pairs = cut(meetings(tiles, widest))
    if seen is not None:
        n = tiles.count()
        seen.append((pairs.count(), n * (n + 1) // 2))
    sides = pairs.select(F.col("a").alias("tile"), "a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("tile"), "a", "b"))
    met = sides.join(tiles.drop("low", "high"), "tile")
    return met.groupBy("a", "b").applyInArrow(lambda key, table: products(key, table, threshold, widest), MATCH)
