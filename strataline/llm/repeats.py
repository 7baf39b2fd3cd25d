"""Operator 8: removal of repeated strings by a distributed sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Every such string has an anchor,
its least hashed K-gram, at the same place in all copies, so only suffixes at anchors are sorted, about one in
80. An anchor stands for the strings whose least K-gram it is: those that start d bytes before it, d1 <= d <=
d2. Anchors whose K-gram is single in the corpus are left out by a count of hashes. For the others each task
sorts its suffixes, front-codes the run (shared prefix lengths and tails) and sends each owner of a hash range
its part; an owner merges the runs with a loser tree that keeps every head's common prefix with the last
output and compares bytes only beyond it. The common prefixes of the merged order, and those of the bytes
before the anchors, then tell for which d an equal string starts elsewhere. Comparisons are of bytes, so
hashes decide nothing but where to look.

Equal texts meet first, by SHA-256, copies collapsing before the exchange: all of a text of LENGTH bytes that has
a copy goes, and one of the copies stands for all in the sort, so repeated rows cost what they read. In the same
way a task sends one of equal contexts (the bytes around an anchor that its strings cover), so that the inside of a
passage that many texts share reaches its owner once from each task; its ends, where texts differ, still all meet.

Defined cases: texts are UTF-8 bytes, null or empty ones have none; rows are documents of their own, so two
rows with one doc_id and one text repeat each other; texts above CHUNK bytes are read in parts that overlap, with
the same result; columns other than the id and the text are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, keyed, marked_by, pieces, shuffle_width
from .nearby import finish

LENGTH, K = 200, 40
#: Bytes hashed at once, and bytes of suffixes in a run.
CHUNK, RUN_BYTES = 1 << 20, 1 << 24
#: Groups up to this size are compared in pairs, larger ones by classes for each d.
PAIRED = 24
#: Random words for bytes.
BYTES = finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on: 32 by doubling, then 8 more."""
    h, parts = BYTES[data], {}
    for k in (1, 2, 4, 8, 16):
        h = h[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + (h[k:] ^ (h[k:] >> np.uint64(29)))
        parts[2 * k] = h
    n = len(data) - K + 1
    return finish(parts[32][:n] + parts[8][32 : 32 + n] * np.uint64(0xA0761D6478BD642F))


def anchors(texts: list[bytes]):
    """(text, hash, place, d1, d2) of the anchors of all strings of LENGTH bytes, for texts hashed together."""
    out = []
    for first, chunk, bounds in chunks(texts):
        if len(chunk) < LENGTH:
            continue
        h = gram_hashes(np.frombuffer(chunk, np.uint8))
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width, low, span = LENGTH - K + 1, key, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(key) - width + 1], low[width - span :][: len(key) - width + 1])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        valid = np.zeros(len(place) + 1, bool)
        which = np.zeros(len(place), np.int64)
        for t, (a, z, _) in enumerate(bounds):
            if z - a >= LENGTH:
                valid[a : z - LENGTH + 1] = True
                which[a : z - LENGTH + 1] = t
        starts = np.flatnonzero(valid[:-1])
        if not len(starts):
            continue
        p, w = place[starts], which[starts]
        turn = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        s1, s2 = starts[turn], starts[np.r_[turn[1:], len(starts)] - 1]
        p, w = p[turn], w[turn]
        base = np.array([a - at for a, _, at in bounds])[w]
        out.append((first + w, h[p].view(np.int64), p - base, p - s2, p - s1))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def chunks(texts: list[bytes]):
    """Texts put together to about CHUNK bytes; a longer text in parts that overlap by LENGTH - 1. Bounds: from, to, place in the text."""
    first, held, bounds, size = 0, [], [], 0
    for k, text in enumerate(texts):
        if len(text) > CHUNK:
            if held:
                yield first, b"".join(held), bounds
            for at in range(0, len(text), CHUNK):
                part = text[at : at + CHUNK + LENGTH - 1]
                yield k, part, [(0, len(part), at)]
            first, held, bounds, size = k + 1, [], [], 0
            continue
        held.append(text)
        bounds.append((size, size + len(text), 0))
        size += len(text)
        if size >= CHUNK:
            yield first, b"".join(held), bounds
            first, held, bounds, size = k + 1, [], [], 0
    if held:
        yield first, b"".join(held), bounds


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(items: list[tuple], texts: list[int]) -> bytes:
    """A sorted run (key, left, index of the text, place, d1, d2) as shared prefix lengths, tails and fields."""
    before, shared, tails = b"", [], []
    for key, *_ in items:
        n = common(before, key)
        shared.append(n)
        tails.append(key[n:])
        before = key
    parts = [
        np.array([len(items), len(texts)], "<u4"), np.array(shared, "<u2"), np.array([len(t) for t in tails], "<u2"), np.array([len(x[1]) for x in items], "<u2"),
        np.array([x[2] for x in items], "<u4"), np.array([x[3] for x in items], "<u8"), np.array([x[4:6] for x in items], "<u2"), np.array(texts, "<i8"),
    ]
    raw = b"".join([*(p.tobytes() for p in parts), *tails, *(x[1] for x in items)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def decoded(run: bytes):
    """Keys with their prefix shared with the one before, and (left, text, place, d1, d2)."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    at = 8
    n, texts = map(int, np.frombuffer(raw, "<u4", 2))

    def take(kind: str, count: int):
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    shared, tails, lefts, which, place, d, ids = take("<u2", n), take("<u2", n), take("<u2", n), take("<u4", n), take("<u8", n), take("<u2", 2 * n).reshape(n, 2), take("<i8", texts)
    which, place, d = ids[which].tolist(), place.tolist(), d.tolist()
    left_at, key, keys, fields = at + int(tails.sum()), b"", [], []
    for s, t, left, k, p, (d1, d2) in zip(shared.tolist(), tails.tolist(), lefts.tolist(), which, place, d, strict=True):
        key = key[:s] + raw[at : at + t]
        at += t
        keys.append(key)
        fields.append((raw[left_at : left_at + left], k, p, d1, d2))
        left_at += left
    return keys, shared.tolist(), fields


def merged(runs: list[tuple]):
    """Loser-tree merge of sorted runs: (key, prefix shared with the key before, fields), comparing bytes only beyond known prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    head = [0] * len(runs)
    known = [0] * len(runs)  # common prefix of each run's head with the last output
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's known prefix becomes that with the winner."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][head[a]], runs[b][0][head[b]]
        n = common(x, y, known[a])
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k if node - k < len(runs) and runs[node - k][0] else -1
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    top = build(1) if k > 1 else (0 if runs and runs[0][0] else -1)
    while top >= 0:
        keys, shared, fields = runs[top]
        at = head[top]
        yield keys[at], known[top], fields[at]
        at += 1
        head[top] = at
        if at < len(keys):
            known[top] = shared[at]
            now = top
        else:
            now = -1
        node = (top + k) // 2
        while node >= 1:
            if loser[node] >= 0:
                now, loser[node] = play(now, loser[node])
            node //= 2
        top = now


def repeated(keys: list[bytes], shared: list[int], fields: list[tuple]) -> list[list[tuple[int, int]]]:
    """For each anchor of a group, in order of the bytes after it: the ranges of d for which an equal string starts elsewhere."""
    n = len(keys)
    if n > PAIRED:
        return by_classes(keys, shared, fields)
    found: list[list[tuple[int, int]]] = [[] for _ in keys]
    for i in range(n):
        left, *_, i1, i2 = fields[i]
        right = 1 << 30
        for j in range(i + 1, n):
            right = min(right, shared[j])
            if right - 8 < K:
                break
            other, *_, j1, j2 = fields[j]
            low, high = max(LENGTH - (right - 8), i1, j1), min(common(left, other), i2, j2)
            if low <= high:
                found[i].append((low, high))
                found[j].append((low, high))
    return found


def by_classes(keys: list[bytes], shared: list[int], fields: list[tuple]) -> list[list[tuple[int, int]]]:
    """The same for large groups: equal contexts are collapsed, then for each d strings with one class of bytes after and one of bytes before are equal."""
    same: dict[tuple, list[int]] = {}
    for i, (key, f) in enumerate(zip(keys, fields, strict=True)):
        same.setdefault((key, f[0], f[3], f[4]), []).append(i)
    groups = list(same.values())
    first = [g[0] for g in groups]  # in order of keys
    m = len(first)
    low = np.zeros(m, np.int64)
    for k in range(1, m):
        low[k] = min(shared[first[k - 1] + 1 : first[k] + 1]) - 8 if keys[first[k]] != keys[first[k - 1]] else len(keys[first[k]]) - 8
    lefts = [fields[i][0] for i in first]
    order = sorted(range(m), key=lefts.__getitem__)
    left_low = np.array([0] + [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    d1, d2 = np.array([fields[i][3] for i in first]), np.array([fields[i][4] for i in first])
    hits = np.zeros((m, LENGTH - K + 2), bool)
    for d in range(int(d1.min()), int(d2.max()) + 1):
        inside = np.flatnonzero((d1 <= d) & (d <= d2))
        if len(inside) < 2:
            continue
        right, left = np.cumsum(low < LENGTH - d), np.empty(m, np.int64)
        left[order] = np.cumsum(left_low < d)
        pair = right[inside] * (m + 1) + left[inside]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        hits[inside, d] = count[back] > 1
    found: list[list[tuple[int, int]]] = [[] for _ in keys]
    for k, g in enumerate(groups):
        if len(g) > 1:
            spans = [(int(d1[k]), int(d2[k]))]
        else:
            edges = np.flatnonzero(np.diff(np.r_[False, hits[k], False]))
            spans = [(int(a), int(z) - 1) for a, z in edges.reshape(-1, 2)]
        for i in g:
            found[i] = spans
    return found


FOUND = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def owner_side(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = tuple([x for xs in table.column(c).to_pylist() for x in xs] for c in ("tid", "start", "end"))  # known to the tasks
    keys, shared, fields = [], [], []

    def close():
        if len(keys) > 1:
            for (_, tid, place, *_), spans in zip(fields, repeated(keys, shared, fields), strict=True):
                for low, high in spans:
                    for to, x in zip(out, (tid, place - high, place - low + LENGTH), strict=True):
                        to.append(x)

    for text, n, f in merged([decoded(r.as_py()) for r in table.column("run")]):
        if n < 8:  # another hash
            close()
            keys, shared, fields = [], [], []
        keys.append(text)
        shared.append(n)
        fields.append(f)
    close()
    return pa.table([pa.array(x, pa.int64()) for x in out], schema=FOUND)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes' kept_sha256 of every row."""
    docs = keyed(docs, id_col, text_col)
    t, owners = Tables(docs.sparkSession), shuffle_width(docs.sparkSession)
    tagged = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("text").cast("binary").alias("body"))
    alike = tagged.where(F.length("body") >= LENGTH).groupBy("sha").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    texts = t.write(alike.select(F.monotonically_increasing_id().alias("tid"), "sha", "body", "copies"))

    def mark(batches):
        for b in pieces(batches):
            k, h, place, d1, d2 = anchors(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0).take(pa.array(k)), pa.array(h, pa.int64()), pa.array(place, pa.int64()), pa.array(d1, pa.int16()), pa.array(d2, pa.int16())], ["tid", "hash", "place", "d1", "d2"])

    marks = t.write(texts.select("tid", "body").mapInArrow(mark, "tid long, hash long, place long, d1 short, d2 short"))
    twice = t.write(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    live = t.write(marks.join(twice, "hash").groupBy("tid").agg(F.collect_list(F.struct("hash", "place", "d1", "d2")).alias("marks")))
    t.drop(marks, twice)

    def runs(batches):
        """A task's sorted runs for each owner. Contexts that it holds twice or more are sent once, and their spans are known."""
        items, first, known, size = [], {}, {}, 0

        def sent():
            items.sort(key=lambda x: (x[0], x[1][0]))
            at = 0
            while at < len(items):
                to, owner = at, items[at][0]
                while to < len(items) and items[to][0] == owner:
                    to += 1
                part = [x[1] for x in items[at:to]]
                used = {k: j for j, k in enumerate(dict.fromkeys(x[2] for x in part))}
                run = front_coded([(*x[:2], used[x[2]], *x[3:]) for x in part], list(used))
                spans = zip(*known.get(owner, ()), strict=True) if owner in known else ([], [], [])
                yield pa.record_batch([pa.array([owner], pa.int32()), pa.array([run], pa.binary()), *(pa.array([list(x)], pa.list_(pa.int64())) for x in spans)], ["owner", "run", "tid", "start", "end"])
                at = to

        for b in pieces(batches):
            for tid, body, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for m in found:
                    p, d1, d2, h = m["place"], m["d1"], m["d2"], m["hash"] & 0xFFFFFFFFFFFFFFFF
                    key, left = h.to_bytes(8, "big") + body[p : p + LENGTH - d1], body[p - d2 : p][::-1]
                    one, owner = (tid, p - d2, p - d1 + LENGTH), h % owners
                    before = first.get((key, left, d1, d2))
                    if before is not None:
                        known.setdefault(owner, []).extend([before, one] if before != () else [one])
                        first[key, left, d1, d2] = ()
                        size += 24
                    else:
                        first[key, left, d1, d2] = one
                        items.append((owner, (key, left, tid, p, d1, d2)))
                        size += LENGTH + d2 - d1
                if size > RUN_BYTES:
                    yield from sent()
                    items, first, known, size = [], {}, {}, 0
        yield from sent()

    sent = texts.select("tid", "body").join(live, "tid").mapInArrow(runs, "owner int, run binary, tid array<long>, start array<long>, end array<long>")
    spans = t.write(sent.groupBy("owner").applyInArrow(owner_side, "tid long, start long, end long"))
    gone = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("body").cast("long").alias("end")))
    found = texts.select("tid", "sha", "copies", F.when(F.col("copies") > 1, whole).alias("whole")).join(gone, "tid", "left")
    cut = t.write(found.select(F.col("sha").alias("own_sha"), F.coalesce("whole", "spans").alias("spans")).where("spans is not null"))
    t.drop(texts, live, spans)

    def kept(batches):
        for b in pieces(batches):
            rows = []
            for body, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                left, at, n = [], 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    if s > at or not n:
                        n += 1
                        left.append(body[at:s])
                    at = max(at, e)
                left.append(body[at:])
                whole = b"".join(left)
                rows.append((len(body), len(body) - len(whole), n, sha256(whole).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = marked_by(tagged, "sha", cut, "own_sha", "some")
    asked = marked.where("some").join(cut, F.col("sha") == F.col("own_sha"), "left").select("doc_id", "body", "spans")
    rest = marked.where("not some").select("doc_id", "body", F.lit(None).cast("array<struct<start: long, end: long>>").alias("spans"))
    return asked.unionByName(rest).mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
