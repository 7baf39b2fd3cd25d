"""Operator 9: near-duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch keeps the K least, so sets
of at most K are kept whole. Rows with equal sets form one node. Retained values are ordered by how often they
occur, rare ones first (a bounded table of the most frequent values decides; any order is lossless), and a node
is listed under the values of its prefix: two sets similar enough share one, for whole sets by counting, for
sampled ones within SIGMAS standard deviations of the overlap.

Each list gets a hub, the node that most of its members have lists with, and members are compared with hubs:
first an estimate from the union of two brief sketches, then the exact comparison of the whole sets, which for
sets above K are built again from the texts. That links most copies at a cost of a few pairs for each node. What
is left are pairs of one list in different components. Two members near one hub can be similar only if their
overlaps with the hub alone would do (a condition on four numbers, joined once for each kind of member), or if
they share values that the hub lacks, as many as make up for it; prefixes of these values, rare ones first within
the group, make the lists of the next level, until no list spans two components, or until the lists left have few
pairs of different components for each node, which are then verified: where a list's members outside its largest
component are few, so are its pairs, however long it is. Each level takes the hub and its values out of a group, so work follows
the differences between copies and not the pairs of a group. Members that are not near the hub of their list
meet the others of the list, under a length and a position filter.

Defined cases: words are runs of anything but ASCII white space, A-Z lower-cased; texts with fewer words than
a shingle are one shingle; null or empty texts have no set, link with nothing and stay; texts of any length are
read whole; an empty table gives an empty result. component_id is the least doc_id reachable, null doc_ids
aside; rows that share a doc_id are rows of their own. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, documents, keyed, marked_by, pieces
from .exact import LOWER

K, SIGMAS = 128, 6
#: Values of a brief sketch (their upper halves), and the share of them that a node has in common with a hub that stands for its group.
BRIEF, NEAR = 32, 0.3
#: Lists that have no more pairs of different components than so many for each node give them all.
PAIRS_A_NODE = 2
#: Bound of the table of frequent values.
FREQUENT = 100_000
#: Pairs, nodes or lists that are not more, which is measured, are broadcast (a row of them is at most 100 bytes).
FEW = 50_000
#: Whole sets that hold not more values together (8 MB), which is measured, are broadcast.
FEW_VALUES = 1 << 20


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.translate(LOWER).split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), len(words))] if words else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
    return np.unique(finish(h))


def digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def sketched(size: int):
    def run(batches):
        for b in pieces(batches):
            sets = [shingles(t.as_py(), size) for t in b.column(1).cast(pa.binary())]
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary())],
                ["doc_id", "tag", "n", "node", "sketch"],
            )

    return run


def often(batches):
    """Values that a task sees twice or more, with their counts."""
    held, size = [], 0

    def counted():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["value", "n"])

    for b in pieces(batches):
        for s in b.column(0):
            held.append(np.frombuffer(s.as_buffer(), np.uint64))
            size += len(held[-1])
        if size > 1 << 20:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def slack(percent: int) -> int:
    """Values of a full sketch that may be missing from the sketch of a similar set."""
    q = 1 - percent / 100
    return min(K - 1, ceil(K * q + SIGMAS * sqrt(K * q * (1 - q))))


def listed(frequent, percent: int):
    """Postings of the prefix: value, node, set size, position."""

    def run(batches):
        values, counts = frequent.value
        for b in pieces(batches):
            out = ([], [], [], [])
            for nid, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(s.as_buffer(), np.uint64)
                seen = np.zeros(len(v), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                    seen = np.where(values[at] == v, counts[at], 0)
                keep = n - -(-percent * n // 100) + 1 if 100 * n < percent * K else slack(percent) + 1
                if n <= K and 100 * n >= percent * K:
                    keep = min(n, max(keep, n - -(-percent * n // 100) + 1))
                order = np.lexsort((v, seen))[:keep]
                out[0].append(v[order].view(np.int64))
                out[1].append(np.full(len(order), nid))
                out[2].append(np.full(len(order), n))
                out[3].append(np.arange(len(order)))
            yield pa.record_batch([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["value", "nid", "n", "pos"])

    return run


def possible(n1, p1, n2, p2, percent: int):
    """Length filter, and for two whole sets the most that can overlap from the shared value on."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    room = F.least(n1 - p1, n2 - p2)
    return (100 * least >= percent * most) & ((most > K) | ((100 + percent) * room >= percent * (n1 + n2)))


def least_share(percent: int, k: int) -> float:
    """The share of a union sketch of k values that two similar sets have in common at least."""
    q = percent / 100
    return q - SIGMAS * sqrt(q * (1 - q) / k)


def estimate(least: float):
    """The pairs (a, b) whose brief sketches agree in that share of their union sketch, or more."""

    def run(batches):
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                union = np.union1d(x, y)[:BRIEF]
                keep.append(np.count_nonzero(np.intersect1d(x, y, assume_unique=True) <= union[-1]) >= least * len(union))
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shortened(batches):
    """nid, n and the brief sketch; halves that meet by chance only make an estimate higher."""
    for b in pieces(batches):
        halves = [np.unique((np.frombuffer(s.as_buffer(), np.uint64)[:BRIEF] >> np.uint64(32)).astype(np.uint32)).tobytes() for s in b.column(2)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(halves, pa.binary())], ["nid", "n", "sketch"])


def compared(batches):
    """a, b, their sizes, how much the whole sets share, and the values of a that b lacks."""
    for b in pieces(batches, 32):
        both, own = [], []
        for x, y in zip(b.column(4), b.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            there = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            both.append(np.count_nonzero(there))
            own.append(x[~there].tobytes())
        yield pa.record_batch([*(b.column(k) for k in range(4)), pa.array(both, pa.int64()), pa.array(own, pa.binary())], ["a", "b", "n1", "n2", "both", "own"])


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def with_both(pairs: DataFrame, held: DataFrame, column: str, few: bool = False, brief: bool = False) -> DataFrame:
    """a, b, their sizes and their values of the column; few pairs are broadcast, with one value each if these are brief."""
    right = held.select(F.col("nid").alias("b"), F.col("n").alias("n2"), F.col(column).alias("y"))
    left = held.select(F.col("nid").alias("a"), F.col("n").alias("n1"), F.col(column).alias("x"))
    one = (F.broadcast(pairs) if few else pairs).join(left, "a")
    return (F.broadcast(one) if few and brief else one).join(right, "b").select("a", "b", "n1", "n2", "x", "y")


def alike(percent: int, both="both", n1="n1", n2="n2"):
    return 100 * F.col(both) >= percent * (F.col(n1) + F.col(n2) - F.col(both))


class Verifier:
    """Pairs of nodes, by their brief sketches and then by their whole sets, which for sets above K come from the texts."""

    def __init__(self, t: Tables, docs: DataFrame, nodes: DataFrame, size: int):
        self.t, self.docs, self.nodes, self.size = t, docs, nodes, size
        self.brief = t.write(nodes.select("nid", "n", "sketch").mapInArrow(shortened, "nid long, n long, sketch binary"))

    def near(self, pairs: DataFrame, least: float, few: bool) -> DataFrame:
        return self.t.write(with_both(pairs, self.brief, "sketch", few, brief=True).mapInArrow(estimate(least), "a long, b long"))

    def whole(self, pairs: DataFrame, few: bool) -> tuple[DataFrame, DataFrame, int]:
        """nid, n and the whole set of each node on a pair, the table to drop after them, and how many values they hold.

        Few pairs need no bitmaps, only the texts found are shuffled, and none are read if every set is kept whole.
        """
        size, t = self.size, self.t
        ids = pairs.select(F.explode(F.array("a", "b")).alias("nid"))
        if few:
            some = self.nodes.join(F.broadcast(ids), "nid", "left_semi")
        else:
            ids = t.write(ids.distinct())
            some = marked_by(self.nodes, "nid", ids, "nid", "some").where("some").drop("some").join(ids, "nid", "left_semi")
        needed = t.write(some.select("nid", "n", "node", "rep_id", "rep_tag", F.when(F.col("n") <= K, F.col("sketch")).alias("sketch")))
        if not few:
            t.drop(ids)
        values, built_sets = needed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("sketch").isNull())).first()
        kept = needed.where("sketch is not null").select("nid", "n", F.col("sketch").alias("whole"))
        if not built_sets:
            return kept, needed, values
        large = needed.where("sketch is null").select("nid", "node", "rep_id", "rep_tag")

        def built(batches):
            for b in pieces(batches, 64):
                sets = [shingles(x.as_py(), size) for x in b.column(2).cast(pa.binary())]
                ok = [digest(s) == d for s, d in zip(sets, b.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["nid", "n", "whole"]).filter(pa.array(ok))

        texts = self.docs
        if few:
            large = F.broadcast(large)
        else:
            texts = marked_by(texts, "tag", large, "rep_tag", "some").where("some").drop("some")
        held = texts.join(large, (F.col("tag") == F.col("rep_tag")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("nid", "node", "text")
        made = held.groupBy("nid", "node").agg(F.first("text").alias("text")).mapInArrow(built, "nid long, n long, whole binary")
        out = t.write(kept.union(made))
        t.drop(needed)
        return out, out, values

    def compare(self, pairs: DataFrame, own: bool = False) -> DataFrame:
        """a, b, n1, n2, both and, if asked for, own."""
        few = 2 * pairs.count() <= FEW
        sets, table, values = self.whole(pairs, few)
        small = few and values <= FEW_VALUES
        done = with_both(pairs, F.broadcast(sets) if small else sets, "whole", few and not small).mapInArrow(compared, "a long, b long, n1 long, n2 long, both long, own binary")
        out = self.t.write(done if own else done.drop("own"))
        self.t.drop(table)
        return out


def ordered(x: str, y: str, names: str = "ab") -> list:
    return [F.least(x, y).alias(names[0]), F.greatest(x, y).alias(names[1])]


def components(t: Tables, edges: DataFrame) -> DataFrame:
    """nid and root (the least nid reachable) of every node on an edge (a, b), by alternating large and small stars.

    A star has no more rows than there are edges, so equal ones are left until the end; the least neighbours of few edges are broadcast.
    """

    def stars(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        near = both.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(F.broadcast(least) if few else least, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # the least neighbour's row stands for u's own
            out = out.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b")

    def settled(pairs: DataFrame) -> bool:
        """Whether each node points to one root and no root to another node."""
        ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(None).cast("long"), F.lit(1)))
        return ends.groupBy("v").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max("down").alias("down")).where("x < y or (x is not null and down > 0)").isEmpty()

    now = t.write(edges.where("a <> b").select(*ordered("b", "a", "ba")))
    few = 2 * now.count() <= FEW
    while True:
        new = t.write(stars(stars(now, True, few), False, few))
        t.drop(now)
        now = new
        if settled(now):
            break
    ends = now.select(F.col("a").alias("nid"), F.col("b").alias("root")).union(now.select("b", "b"))
    out = t.write(ends.groupBy("nid").agg(F.min("root").alias("root")))
    t.drop(now)
    return out


def shared_lists(lists: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Lists whose members are in two components or more; without roots, each node is one of its own.

    group, value, as a first hub a member with few rare values, the component of most members (main; null without roots),
    and the most pairs of different components that the list can have.
    """
    key, deep = ["group", "value"], F.struct((F.col("pos") / F.col("n")).alias("depth"), "nid")
    if roots is None:
        found = lists.groupBy(*key).agg(F.min(deep).alias("p"), F.count("*").alias("members")).where("members > 1")
        return found.select(*key, F.col("p.nid").alias("hub"), F.lit(None).cast("long").alias("main"), F.expr("members * (members - 1) div 2").alias("pairs"))
    parts = rooted(lists, roots, "nid").groupBy(*key, "nid_root").agg(F.min(deep).alias("p"), F.count("*").alias("c"))
    most = F.max(F.struct("c", "nid_root")).alias("most")
    found = parts.groupBy(*key).agg(F.min("p").alias("p"), most, (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    return found.select(*key, F.col("p.nid").alias("hub"), F.col("most.nid_root").alias("main"), F.expr("others * most.c + others * (others - 1) div 2").alias("pairs"))


def hubs_of(t: Tables, lists: DataFrame, first: DataFrame, few: bool) -> DataFrame:
    """The lists of `first` (group, value, nid, n, pos), with a hub for each.

    A list points to its first hub; a node's home is the one that most of its lists point
    to; the list's hub is the home of most of its members, which is a member of the group, though not of each list.
    """
    key = ["group", "value"]
    hub = first.select(*key, "hub")
    if few:
        live = lists.join(F.broadcast(hub), key)
    else:
        some = marked_by(lists, "value", first, "value", "some").where("some").drop("some")  # most values are in no shared list
        live = some.join(hub, key)
    # All that a node's home takes is in its own lists, so one shuffle by nodes does.
    held = live.repartition("group", "nid").withColumn("c", F.count("*").over(Window.partitionBy("group", "nid", "hub")))
    at_home = held.withColumn("home", F.max_by("hub", F.struct("c", -F.col("hub"))).over(Window.partitionBy("group", "nid")))
    at_home = t.write(at_home.drop("hub", "c"))
    hubs = at_home.groupBy(*key, "home").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max_by("home", F.struct("c", -F.col("home"))).alias("hub"))
    out = t.write(at_home.drop("home").join(F.broadcast(hubs) if few else hubs, key))
    t.drop(at_home)
    return out


def spread(batches):
    """group, nid, n and own, first -> a row for each value."""
    for b in pieces(batches):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(4)]
        times = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        columns = [b.column(k).take(times) for k in range(4)]
        yield pa.record_batch([*columns, pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["outer", "group", "nid", "n", "value"])


def rooted(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(roots.select(F.col("nid").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return df


def linked(t: Tables, lists: DataFrame, verifier: Verifier, percent: int) -> DataFrame:
    """nid and root of all nodes on a link between nodes that share a list (group, value, nid, n, pos). See the module's text."""
    roots = t.write(verifier.brief.where("false").select("nid", F.col("nid").alias("root")))
    light = lambda df, few: F.broadcast(df) if few else df
    before = None  # the values, group by group, that no hub above holds

    def added(found: DataFrame) -> DataFrame:
        new = found.where(alike(percent)).select("a", "b")
        if new.isEmpty():
            return roots
        both = components(t, new.union(roots.select(F.col("nid").alias("a"), F.col("root").alias("b"))))
        t.drop(roots)
        return both

    def met(pairs: DataFrame) -> DataFrame:
        """The roots after all of these pairs are verified."""
        pairs = t.write(pairs.distinct())
        likely = verifier.near(pairs, least_share(percent, BRIEF), pairs.count() <= FEW)
        if likely.isEmpty():
            t.drop(pairs, likely)
            return roots
        more = verifier.compare(likely)
        out = added(more)
        t.drop(pairs, likely, more)
        return out

    nodes = verifier.brief.count()
    first = t.write(shared_lists(lists))
    while True:
        crossing, shared = first.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
        if crossing <= PAIRS_A_NODE * nodes:  # then these pairs cost less than hubs
            if crossing:
                mains = first.select("group", "value", "main")
                at = rooted(lists.join(light(mains, shared <= FEW), ["group", "value"]), bounded(roots), "nid").withColumn("inner", F.coalesce(F.col("nid_root") == F.col("main"), F.lit(False)))
                x, y = at.where("not inner").alias("x"), at.alias("y")
                same = (F.col("x.group") == F.col("y.group")) & (F.col("x.value") == F.col("y.value")) & (F.col("y.inner") | (F.col("x.nid") < F.col("y.nid"))) & (F.col("x.nid_root") != F.col("y.nid_root"))
                roots = met(x.join(y, same & possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)).select(*ordered("x.nid", "y.nid")))
            t.drop(lists, first, *([before] if before else []))
            return roots
        live = hubs_of(t, lists, first, shared <= FEW)
        t.drop(lists, first)
        few = live.count() <= FEW  # then nothing that is made of the lists has more rows, but for pairs
        # Hubs and the members that may be near them.
        at_hub = live.where("nid = hub").select("group", "value", F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))
        ahead = live.where("nid <> hub").join(light(at_hub, few), ["group", "value"], "left")
        meets = F.coalesce(possible(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent), F.lit(False))
        asked = ahead.select(F.col("nid").alias("a"), F.col("hub").alias("b"), meets.alias("meets")).repartition("a")  # by a, which is joined next
        asked = asked.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("meets").alias("meets")).where("meets or c > 1").select("a", "b")
        close = verifier.near(asked, min(NEAR, least_share(percent, BRIEF)), few)
        near = verifier.compare(close, own=True)
        roots = added(near)
        at_roots, few_near = bounded(roots), near.count() <= FEW

        # Members that are not near the hub of a list meet all others of the list.
        beside = near.select(F.col("a").alias("nid"), F.col("b").alias("hub"), F.lit(True).alias("close"))
        others = t.write(rooted(live.where("nid <> hub").join(light(beside, few_near), ["nid", "hub"], "left"), at_roots, "nid"))
        x, y = others.where("close is null").alias("x"), others.alias("y")
        apart = (F.col("x.nid_root") != F.col("y.nid_root")) & (F.col("y.close") | (F.col("x.nid") < F.col("y.nid")))
        fits = possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
        same_list = (F.col("x.group") == F.col("y.group")) & (F.col("x.value") == F.col("y.value"))
        strangers = light(x, few).join(y, same_list & F.coalesce(apart, F.lit(False)) & fits).select(*ordered("x.nid", "y.nid"))

        # Members near one hub: those that may be similar without a common value beyond the hubs meet now, others in lists of such values.
        asides = near.select(F.col("a").alias("nid"), F.col("b").alias("hub"), "n1", "own")
        around = live.select("group", "hub", "nid").repartition("hub", "nid").distinct().join(asides, ["hub", "nid"])
        around = rooted(around, at_roots, "hub", "nid")
        around = around.select(F.col("group").alias("outer"), F.xxhash64("group", "hub").alias("group"), "nid", F.col("n1").alias("n"), "own", F.col("nid_root").alias("root"), (F.col("nid_root") == F.col("hub_root")).alias("main"))
        mixed = around.groupBy("group").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("group")
        around = t.write(around.join(light(mixed, few or few_near and before is None), "group", "left_semi"))  # at first there is one group
        few = around.count() <= FEW
        values = around.select("outer", "group", "nid", "n", "own").mapInArrow(spread, "outer long, group long, nid long, n long, value long")
        if before is not None:
            values = values.join(before.select(F.col("group").alias("outer"), "nid", "value"), ["outer", "nid", "value"], "left_semi")
        values = t.write(values.select("group", "value", "nid", "n"))
        beyond = values.groupBy("group", "nid").agg(F.count("*").alias("beyond"))
        members = t.write(around.join(beyond, ["group", "nid"], "left").select("group", "nid", "n", "root", "main", (F.col("n") - F.coalesce("beyond", F.lit(0))).alias("inside")))
        kinds = members.groupBy("group", "n", "inside", "main").agg(F.count("*").alias("c"))
        u, v = kinds.where("not main").alias("u"), kinds.alias("v")
        enough = (100 + percent) * F.least("u.inside", "v.inside") >= percent * (F.col("u.n") + F.col("v.n"))
        some = light(u, few).join(v, (F.col("u.group") == F.col("v.group")) & enough).select("u.group", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "uv" for c in ("n", "inside", "main")))
        of = lambda s: members.select("group", *(F.col(c).alias(f"{s}_{c}") for c in ("nid", "root", "n", "inside", "main")))
        for s in "uv":
            some = some.join(light(of(s), few), ["group", f"{s}_n", f"{s}_inside", f"{s}_main"])
        nested = some.where("u_root <> v_root").select(*ordered("u_nid", "v_nid"))

        roots = met(strangers.union(nested))
        # The next lists: of each member's values that the hubs lack, rare ones first, as many as must hold one that a similar member shares.
        smallest = members.groupBy("group").agg(F.min("n").alias("least"))
        wanted = members.join(light(smallest, few), "group").withColumn("least", F.greatest("least", F.ceil(percent * F.col("n") / 100)))
        need = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent)) - F.col("inside")
        wanted = wanted.select("group", "nid", (F.col("n") - F.col("inside") - F.greatest(need, F.lit(1)) + 1).alias("keep"))
        often_in = values.groupBy("group", "value").agg(F.count("*").alias("times"))
        rank = F.row_number().over(Window.partitionBy("group", "nid").orderBy("times", "value"))
        heads = values.join(often_in, ["group", "value"]).withColumn("pos", rank).join(light(wanted, few), ["group", "nid"]).where("pos <= keep and times > 1")
        heads = t.write(heads.select("group", "value", "nid", "n", (F.col("pos") - 1).cast("long").alias("pos")))
        first = t.write(shared_lists(heads, bounded(roots)))
        t.drop(live, close, near, others, around, members, *([before] if before else []))
        lists, before = heads, values


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = keyed(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    context, t = docs.sparkSession.sparkContext, Tables(docs.sparkSession)
    rows = t.write(docs.mapInArrow(sketched(size), "doc_id long, tag long, n long, node binary, sketch binary"))
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"), F.min(F.struct("tag", "doc_id")).alias("rep"))
    nodes = t.write(nodes.select(F.monotonically_increasing_id().alias("nid"), "n", "node", "sketch", "doc_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag")))
    light = t.write(rows.select("doc_id", "n", "node"))
    t.drop(rows)
    top = nodes.select("sketch").mapInArrow(often, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "value").limit(FREQUENT).collect()
    values = np.array([r["value"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    frequent = context.broadcast((values[order], np.array([r["n"] for r in top], np.int64)[order]))
    postings = nodes.select("nid", "n", "sketch").mapInArrow(listed(frequent, percent), "value long, nid long, n long, pos long")
    lists = t.write(postings.select(F.lit(0).cast("long").alias("group"), "value", "nid", "n", "pos"))
    verifier = Verifier(t, docs, nodes, size)
    roots = linked(t, lists, verifier, percent)
    found = nodes.select("nid", "doc_id").join(bounded(roots), "nid")
    least = t.write(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    reached = t.write(found.join(bounded(least), "root").select("nid", "component_id"))
    classes = t.write(nodes.select("node", "nid", "doc_id").join(bounded(reached), "nid", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")))
    t.drop(nodes, verifier.brief, roots, least, reached)
    whole = light.where("n > 0").join(classes, "node").select("doc_id", "n", "component_id")
    out = whole.union(light.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)
