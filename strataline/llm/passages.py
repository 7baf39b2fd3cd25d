"""Operator 11: removal of passages that an earlier document holds, by FM-indexes of shards.

A word goes if WINDOW consecutive words that cover it also start in a document with a smaller id. Every such window has
an anchor, its least hashed K-gram of words, at the same place in all its copies. An anchor and the words that its
windows cover make a context; contexts are dealt to shards by the hash of the anchor's gram, so that all copies of a
window meet in one shard, and grams with one context alone never leave the table of anchors.

A shard builds an FM-index over its contexts: suffixes are sorted by doubling, the Burrows-Wheeler transform of word
numbers is kept as a wavelet tree of packed bits with counts of ones, beside the common prefix lengths of neighbouring
suffixes and the smallest ids of ranges of suffixes. The contexts then stream through it, all at once and each from its
last word to its first: a backward search step where the longer match still occurs in an earlier document, else one up
to the interval of a shorter match. That gives matching statistics against earlier documents; starts with WINDOW words
or more are reported as intervals.

Contexts that are equal in all 128 bits of their two hashes collapse before any text is shuffled, under the smallest id;
all their other owners lose the whole context. Grams with more than a bounded number of different contexts, as the
documents of a large group of near copies make, are taken as anchors only where a window has no other: the
frequencies of the grams near them are counted, and the windows that held one get their rarest kind of gram instead, so
that an edited copy meets what shares its edit, and of the rest at most 41 * 42 / 2 different parts of one text are
left to an anchor, however many copies there are. Neither rule changes results.

Defined cases: words are the runs of bytes between ASCII white space, unchanged; null and empty texts have none; rows
with a null id count as earlier than all others; rows that share an id do not count as earlier than each other, so they
leave each other whole; texts of fewer than WINDOW words lose nothing; other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, keyed, marked_by, pieces, shuffle_width
from .nearby import finish

WINDOW, K = 50, 10
#: Words that are hashed together, and words of a shard.
CHUNK, SHARD = 1 << 18, 1 << 19
#: Contexts of a gram beyond which it is hot: so many at least, and so large a share of all that no more than 1 / share are.
CROWD, SHARE = 1000, 1 / 50_000
#: Stands for a null id, smaller than all others.
FIRST = -(1 << 63)
#: Multipliers of the hashes of grams and of windows.
GRAM, WIDE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
MARKS = "tid long, doc long, gram long, ctx long, start int, end int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, None], object)[:-1], categorize=False)


def combined(h: np.ndarray, width: int, by: int) -> np.ndarray:
    """A hash of the `width` numbers from each place on: by doubling, then the parts of the width."""
    n, level, parts, span = len(h) - width + 1, h, [], 1
    at = 0
    while span <= width:
        if width & span:
            parts.append(level[at : at + n])
            at += span
        span *= 2
        if span <= width:
            level = level[: len(level) - span // 2] * np.uint64(by) + finish(level[span // 2 :])
    out = parts[0]
    for p in parts[1:]:
        out = out * np.uint64(0xA0761D6478BD642F) + finish(p)
    return finish(out)


def least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` numbers from each place on."""
    low, span, n = key, 1, len(key) - width + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span :][:n])


def chunks(texts: list[list[bytes]]):
    """Texts' words put together to about CHUNK; a longer text in parts that overlap by WINDOW - 1. Bounds: text, from, to, place in the text."""
    held, bounds = [], []
    for k, words in enumerate(texts):
        for at in range(0, max(len(words) - WINDOW + 1, 0), CHUNK):
            part = words[at : at + CHUNK + WINDOW - 1]
            bounds.append((k, len(held), len(held) + len(part), at))
            held += part
            if len(held) >= CHUNK:
                yield held, bounds
                held, bounds = [], []
    if held:
        yield held, bounds


def anchors(texts: list[list[bytes]], hot: np.ndarray | None = None):
    """text, gram, ctx, start and end of each context: its windows start from start to end - WINDOW, and share one anchor, a gram.

    hot: sorted grams that are anchors of windows without another alone.
    """
    out = []
    for words, bounds in chunks(texts):
        h = word_hashes(words)
        grams, wide = combined(h, K, GRAM), combined(h, WINDOW, WIDE)
        order = grams >> np.uint64(1)
        if hot is not None and len(hot):
            found = grams.view(np.int64)
            order = order | (np.uint64(1 << 63) * (hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found))
        key = (order >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
        place = (least(key, WINDOW - K + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        which = np.full(len(place), -1)
        base = np.zeros(len(bounds), np.int64)
        for j, (_, a, z, at) in enumerate(bounds):
            which[a : z - WINDOW + 1] = j
            base[j] = at - a
        starts = np.flatnonzero(which >= 0)
        p, w = place[starts], which[starts]
        turn = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        s1, s2 = starts[turn], starts[np.r_[turn[1:], len(starts)] - 1]
        p, w = p[turn], w[turn]
        ctx = finish(wide[s1] * np.uint64(0xE7037ED1A0B428DB) + finish(wide[s2] + (s2 - s1).astype(np.uint64)))  # the first and the last window overlap, so both are all words
        out.append((np.array([b[0] for b in bounds])[w], grams[p].view(np.int64), ctx.view(np.int64), s1 + base[w], s2 + WINDOW + base[w]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


class Bits:
    """A level of a wavelet tree: packed bits, and the ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Occurrences of a number among the first ones of a sequence, a level for each bit of the numbers."""

    def __init__(self, numbers: np.ndarray, most: int):
        self.depth = max(1, int(most).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.depth - 1, -1, -1):
            bits = (numbers >> k) & 1
            self.levels.append(Bits(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            numbers = np.concatenate([numbers[bits == 0], numbers[bits == 1]])
        self.first = np.searchsorted(self.reversed_order(numbers), self.reversed_order(np.arange(most + 1)))

    def reversed_order(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers with their bits turned round, the order in which the last level leaves them."""
        out = np.zeros(len(numbers), np.int64)
        for k in range(self.depth):
            out |= ((numbers >> k) & 1) << (self.depth - 1 - k)
        return out

    def count(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = at
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(place)
            place = np.where((number >> (self.depth - 1 - k)) & 1, zeros + ones, place - ones)
        return place - self.first[number]


class FMIndex:
    """Contexts as word numbers, each ended by its own separator: backward search, intervals of shorter matches, least owner of a range."""

    def __init__(self, contexts: list[np.ndarray], owners: np.ndarray):
        m, sizes = len(contexts), np.array([len(c) + 1 for c in contexts])
        ends = np.cumsum(sizes) - 1
        text = np.empty(int(sizes.sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(contexts) + m
        text[ends] = np.arange(m)
        self.n = n = len(text)
        ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        span = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - span] = ranks[-1][span:] + 1
            key = ranks[-1] * (n + 1) + nxt
            order = np.argsort(key)
            turn = np.r_[0, np.diff(key[order]) != 0].cumsum()
            if turn[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = turn
            ranks.append(rank)
            span *= 2
        lcp, a, b = np.zeros(n + 1, np.int64), order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):  # ranks[k] tells whether the next 2**k words are equal
            same = (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]) & (a < n) & (b < n)
            lcp[1:n] += same * (1 << k)
            a, b = a + same * (1 << k), b + same * (1 << k)
        self.lcp = lcp.astype(np.int32)
        self.lcp[0] = self.lcp[n] = -1
        word = np.where(inside, text - m + 1, 0)
        self.tree = WaveletTree(word[order - 1], int(word.max()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=int(word.max()) + 1))])
        owner = np.repeat(owners, sizes)[order].astype(np.int32)
        self.low = [owner]
        while 2 << (len(self.low) - 1) <= n:
            half, last = 1 << (len(self.low) - 1), self.low[-1]
            self.low.append(np.minimum(last[:-half], last[half:]))
        self.left, self.right = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)  # the nearest places with a smaller common prefix
        for depth in np.unique(self.lcp[self.lcp > 0]):
            at, smaller = np.flatnonzero(self.lcp == depth), np.flatnonzero(self.lcp < depth)
            k = np.searchsorted(smaller, at)
            self.left[at], self.right[at] = smaller[k - 1], smaller[k]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of non-empty ranges of suffixes."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.low[k][lo[at]], self.low[k][hi[at] - (1 << int(k))])
        return out

    def statistics(self, contexts: list[np.ndarray], owners: np.ndarray) -> list[np.ndarray]:
        """For each place of each context the length of the longest match from there on in a context of a smaller owner."""
        sizes = np.array([len(c) for c in contexts])
        first = np.cumsum(sizes) - sizes
        words, found = np.concatenate(contexts) + 1, np.zeros(int(sizes.sum()), np.int32)
        row = np.flatnonzero(sizes > 0)
        at, lo, hi, depth = (first + sizes - 1)[row], np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64), np.zeros(len(row), np.int64)
        own, stop = owners[row], first[row]
        while len(at):
            c = words[at]
            both = self.tree.count(np.concatenate([c, c]), np.concatenate([lo, hi])) + self.before[np.concatenate([c, c])]
            lower, upper = both[: len(c)], both[len(c) :]
            longer = lower < upper
            some = np.flatnonzero(longer)
            longer[some] = self.least_owner(lower[some], upper[some]) < own[some]
            # where the match cannot grow it is shortened to the next larger interval, or ended if it has no word
            up = ~longer & (depth > 0)
            edge = np.where(self.lcp[lo] >= self.lcp[hi], lo, hi)
            shorter = self.lcp[edge]
            lo, hi, depth = (
                np.where(longer, lower, np.where(up & (shorter > 0), self.left[edge], 0)),
                np.where(longer, upper, np.where(up & (shorter > 0), self.right[edge], self.n)),
                np.where(longer, depth + 1, np.where(up, np.maximum(shorter, 0), 0)),
            )
            found[at[longer]] = depth[longer]
            at = at - ~up
            live = at >= stop
            if not live.all():
                at, lo, hi, depth, own, stop = (x[live] for x in (at, lo, hi, depth, own, stop))
        return np.split(found, first[1:])


def searched(contexts: list[bytes], docs: list[int]) -> list[list[tuple[int, int]]]:
    """The intervals of words of each context that an earlier document's context holds."""
    split = [c.split(b" ") for c in contexts]
    numbers, _ = pd.factorize(np.array([w for words in split for w in words] + [None], object)[:-1])
    sizes = np.array([len(words) for words in split])
    coded = np.split(numbers, np.cumsum(sizes)[:-1])
    owners = np.unique(np.array(docs), return_inverse=True)[1].astype(np.int32)
    out = []
    for found in FMIndex(coded, owners).statistics(coded, owners):
        starts = np.flatnonzero(found >= WINDOW)
        turn = np.flatnonzero(np.diff(starts, prepend=-2 * WINDOW) > WINDOW)
        out.append([(int(starts[a]), int(starts[z - 1]) + WINDOW) for a, z in zip(turn, [*turn[1:], len(starts)], strict=True)] if len(starts) else [])
    return out


SPANS = "gram long, ctx long, doc long, spans array<struct<start: int, end: int>>"


def shards(batches):
    """Rows of (gram, ctx, doc, words) in order of gram -> the spans of each context; grams stay whole, and a shard has about SHARD words."""
    rows, size, last = [], 0, None

    def closed():
        made = searched([r[3] for r in rows], [r[2] for r in rows])
        kept = [(*r[:3], [{"start": a, "end": z} for a, z in spans]) for r, spans in zip(rows, made, strict=True) if spans]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.record_batch([pa.array([r[k] for r in kept], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), kind))], ["gram", "ctx", "doc", "spans"])

    for b in pieces(batches):
        for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if size > SHARD and row[0] != last:
                yield closed()
                rows, size = [], 0
            rows.append(row)
            size, last = size + row[3].count(b" ") + 2, row[0]
    if rows:
        yield closed()


def marked(texts: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """The contexts of tid, doc and body."""

    def run(batches):
        for b in pieces(batches):
            k, *rest = anchors([body.split() for body in b.column(2).to_pylist()], hot)
            k = pa.array(k)
            yield pa.record_batch([b.column(0).take(k), b.column(1).take(k), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))], [x.split()[0] for x in MARKS.split(", ")])

    return texts.select("tid", "doc", "body").mapInArrow(run, MARKS)


def near_hot(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """gram and n: how often each gram occurs in the contexts of hot grams."""

    def run(batches):
        for b in pieces(batches):
            split = [body.split() for body in b.column(0).to_pylist()]
            k, gram, _, start, end = anchors(split)
            mine, out = np.isin(gram, hot), []
            for j in np.unique(k[mine]):
                h = combined(word_hashes(split[j]), K, GRAM)
                inside = np.zeros(len(h) + 1, np.int32)
                here = mine & (k == j)
                np.add.at(inside, start[here], 1)
                np.add.at(inside, end[here] - K + 1, -1)
                out.append(h[np.cumsum(inside)[:-1] > 0])
            if out:
                values, counts = np.unique(np.concatenate(out), return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["gram", "n"])

    return texts.select("body").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def hot_grams(texts: DataFrame, groups: DataFrame, several: DataFrame, crowd: int, t: Tables) -> np.ndarray:
    """Sorted grams with too many contexts, and those as frequent near them; at most 2 / SHARE values, whatever the corpus."""
    most = lambda rows: max(crowd, int(SHARE * rows))  # noqa: E731  at most 1 / SHARE values are above it
    listed = lambda rows: np.sort(np.array([r[0] for r in rows.select("gram").collect()], np.int64))
    hot = listed(several.where(F.col("contexts") > most(groups.count())))
    if not len(hot):
        return hot
    near = t.write(near_hot(texts, hot).where(F.col("n") > crowd))
    wide = listed(near.where(F.col("n") > most(near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])))
    t.drop(near)
    return np.union1d(hot, wide)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) of every row."""
    docs = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    t, width = Tables(spark), shuffle_width(spark)
    texts = t.write(docs.select(F.monotonically_increasing_id().alias("tid"), "doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), F.col("text").cast("binary").alias("body")))

    def met(hot: np.ndarray | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The contexts of all texts, those that differ with their least owner, and grams with several of these."""
        marks = t.write(marked(texts, hot))
        groups = t.write(marks.groupBy("gram", "ctx").agg(F.min("doc").alias("least"), F.count("*").alias("n")))
        return marks, groups, t.write(groups.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"))

    marks, groups, several = met(None)
    hot = hot_grams(texts, groups, several, crowd, t)
    if len(hot):
        t.drop(marks, groups, several)
        marks, groups, several = met(hot)
    both = F.xxhash64("gram", "ctx")
    some = marked_by(groups, "gram", several, "gram", "some").where("some").join(several, "gram", "left_semi")
    asked = t.write(some.select(F.col("gram").alias("g"), F.col("ctx").alias("c"), "least", both.alias("id")))
    own = marked_by(marks.withColumn("own", both), "own", asked, "id", "some").where("some")
    one = own.join(asked, (F.col("gram") == F.col("g")) & (F.col("ctx") == F.col("c")) & (F.col("doc") == F.col("least")))
    one = one.groupBy("gram", "ctx", "doc").agg(F.min(F.struct("tid", "start", "end")).alias("one")).select("gram", "ctx", "doc", "one.*")  # where a document repeats itself
    wanted = t.write(one.groupBy("tid", "doc").agg(F.collect_list(F.struct("gram", "ctx", "start", "end")).alias("asked")))
    t.drop(several, asked)

    def cut(batches):
        for b in pieces(batches):
            out = []
            for doc, body, asked in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = body.split()
                out += [(x["gram"], x["ctx"], doc, b" ".join(words[x["start"] : x["end"]])) for x in asked]
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["gram", "ctx", "doc", "words"])

    sent = marked_by(texts, "tid", wanted, "tid", "some").where("some").select("tid", "body").join(wanted, "tid").select("doc", "body", "asked").mapInArrow(cut, "gram long, ctx long, doc long, words binary")
    found = t.write(sent.repartition(width, "gram").sortWithinPartitions("gram").mapInArrow(shards, SPANS))
    t.drop(wanted)
    whole = groups.where("n > 1").select(F.col("gram").alias("g"), F.col("ctx").alias("c"), "least", F.lit(True).alias("all"), F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"))
    parts = found.select(F.col("gram").alias("g"), F.col("ctx").alias("c"), F.col("doc").alias("least"), F.lit(False).alias("all"), "spans")
    told = t.write(whole.unionByName(parts).withColumn("id", F.xxhash64("g", "c")))
    t.drop(groups, found)
    named = marked_by(marks.withColumn("own", both), "own", told, "id", "some").where("some")
    # of a context with several owners all but the least lose all of it, and the least one what its shard has found
    lost = named.join(told, (F.col("gram") == F.col("g")) & (F.col("ctx") == F.col("c")) & ((F.col("all") & (F.col("doc") > F.col("least"))) | (~F.col("all") & (F.col("doc") == F.col("least")))))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    spans = lost.select("tid", F.explode(F.coalesce(moved, F.array(F.struct("start", "end")))).alias("span"))
    gone = t.write(spans.groupBy("tid").agg(F.collect_list("span").alias("spans")))
    t.drop(marks, told)

    def kept(batches):
        for b in pieces(batches):
            rows = []
            for body, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, left, at = body.split(), [], 0
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    left += words[at:s] if s > at else []
                    at = max(at, e)
                left += words[at:]
                rows.append((len(words), len(words) - len(left), b" ".join(left)))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    flagged = marked_by(texts, "tid", gone, "tid", "some")
    some = flagged.where("some").join(gone, "tid", "left").select("doc_id", "body", "spans")
    rest = flagged.where("not some").select("doc_id", "body", F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"))
    return some.unionByName(rest).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op11_fm_index_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_passages(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
