"""Operator 10: best-fit packing of token pieces by exact-complement hashing.

Lengths are integers of at most ``capacity``, so the whole plan depends on a histogram of bounded size:
single, pair and triple sums of the lengths still available are looked up to fill gaps exactly, in bulk and
under availability counts; what is left goes best-fit decreasing. The plan is a list of slots
(length, ranks from..to -> sequences from.., offset); each piece finds its slot from its rank among the
pieces of its length. Ranks come from counts per task, so no length is ever gathered in one task.

Null texts are empty (one end id), null doc_ids are kept, repeated rows are packed separately, an empty
table gives an empty result, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, keyed, materialise, pieces
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, block int, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(capacity: int, end_id: int, vocab: str | None):
    def run(batches):
        block, seen, enc, end = TaskContext.get().partitionId(), Counter(), encoder(vocab), np.array([end_id], "<u4").tobytes()
        for b in pieces(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((i, k, at // 4, n, zlib.crc32(piece), block, seen[n]))
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)
        enc.clear()  # the worker goes on to other stages, where its words are no use

    return run


class Sums:
    """Hash index of the sums of one, two and three of the lengths available, for exact complements of a gap.

    pairs: sum -> larger lengths a of the pairs (a, sum - a), triples: sum -> largest lengths c of the triples, both
    in ascending order. Counts only fall, so entries found dead for lack of pieces leave the index for good.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = Counter(counts)
        lengths = np.array(sorted(n for n, c in counts.items() if c), np.int64)
        self.pairs: dict[int, list[int]] = {}
        least = np.full(capacity + 1, capacity + 1)  # of each pair sum, the least larger length
        for a in lengths.tolist():
            for b in lengths[: np.searchsorted(lengths, min(a, capacity - a), "right")].tolist():
                self.pairs.setdefault(a + b, []).append(a)
        for total, larger in self.pairs.items():
            least[total] = larger[0]
        self.triples: dict[int, list[int]] = {}
        for c in lengths.tolist():
            for total in (np.flatnonzero(least[: capacity - c + 1] <= c) + c).tolist() if c <= capacity else ():
                self.triples.setdefault(total, []).append(c)

    def take(self, n: int, times: int) -> None:
        self.left[n] -= times

    def pair(self, gap: int, at_most: int) -> tuple[int, int] | None:
        """The pair a >= b with a + b = gap, a <= at_most and the largest a, or None."""
        larger = self.pairs.get(gap, [])
        k = bisect_right(larger, at_most) - 1
        while k >= 0:
            a, b = larger[k], gap - larger[k]
            if a != b and self.left[a] and self.left[b] or a == b and self.left[a] > 1:
                return a, b
            del larger[k]
            k -= 1
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """The fewest lengths, larger ones first, that sum to the gap."""
        if gap <= 0:
            return None
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, gap - 1):
            return found
        largest = self.triples.get(gap, [])
        for k in range(len(largest) - 1, -1, -1):
            c = largest[k]
            if not self.left[c]:
                del largest[k]
                continue
            found = self.pair(gap - c, c)
            if found and all(self.left[x] >= n for x, n in Counter((c, *found)).items()):
                return (c, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins for a histogram of lengths: (how many alike, ((length, first rank), ...)) in order of offset."""
    sums, used = Sums(counts, capacity), Counter()
    bins: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)

    def slots(lengths: tuple[int, ...], times: int) -> tuple[tuple[int, int], ...]:
        out = []
        for n in lengths:
            out.append((n, used[n]))
            used[n] += times
        return tuple(out)

    rest: list[tuple[int, int]] = []
    for n in sorted(counts, reverse=True):
        while (have := sums.left[n]) > 0:
            sums.take(n, 1)  # the bin's own piece is not its complement
            found = () if n == capacity else sums.fill(capacity - n)
            sums.take(n, -1)
            if found is None:
                rest.append((n, have))
                sums.take(n, have)
                break
            need = Counter((n, *found))
            times = min(sums.left[x] // k for x, k in need.items())
            for x, k in need.items():
                sums.take(x, k * times)
            bins.append((times, slots((n, *found), times)))
    gaps = 0  # bit g: there are open bins with g free
    for n, have in rest:
        while have:
            fitting = gaps >> n
            if fitting:
                g = n + (fitting & -fitting).bit_length() - 1
                times, inside = open_[g].pop()
                if not open_[g]:
                    gaps ^= 1 << g
                now = min(times, have)
                if now < times:
                    open_[g].append((times - now, tuple((x, r + now) for x, r in inside)))
                    gaps |= 1 << g
                filled = (now, inside + slots((n,), now))
                have, g = have - now, g - n
            else:
                each = min(have, capacity // n)
                now = have // each
                filled = (now, slots((n,) * each, now))
                have, g = have - now * each, capacity - n * each
            if g:
                open_[g].append(filled)
                gaps |= 1 << g
            else:
                bins.append(filled)
    return bins + [x for group in open_.values() for x in group]


def slot_table(bins) -> dict[str, np.ndarray]:
    rows, base = [], 0
    for times, inside in bins:
        at = 0
        for n, rank in inside:
            rows.append((n, rank, base, at))
            at += n
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) | a[:, 1], "rank": a[:, 1], "base": a[:, 2], "at": a[:, 3]}


def place(slots):
    def run(batches):
        t = slots.value
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(t["key"], (n.astype(np.int64) << 44) | rank, side="right") - 1
            get = lambda c: b.column(b.schema.get_field_index(c))
            yield pa.record_batch(
                [get("doc_id"), get("piece"), get("start"), pa.array(n, pa.int64()), get("ids_crc32"), pa.array(t["base"][k] + rank - t["rank"][k]), pa.array(t["at"][k])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text for the defined cases."""
    spark = docs.sparkSession
    pieces = materialise(keyed(docs, id_col, text_col).mapInArrow(cut(capacity, end_id, vocab), PIECES))
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(slot_table(plan(histogram, capacity)))
    ranked = pieces.join(offsets, ["block", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place(slots), PACKED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
