import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet

from strataline.llm import prefixes

from .oracle import both

SF = "/root/testdata/sf0.01"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, p int, conv string, size int"


def brute(convs):
    """convs: id -> list of (role, text), as they are."""
    nodes = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    out = Counter()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        childless = [p for p in below if not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in nodes)]
        children = sum(len(p) == len(path) + 1 for p in below)
        out[min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(childless), saved, sha256(ends.encode()).hexdigest()] += 1
    return out


def grouped(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def with_heads(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def made_up(rng, ids):
    rows = []
    for c in ids:
        for k in range(rng.choice((1, 1, 2, 3, 6, 9))):
            rows.append((c, rng.choice((k, k * 3)), rng.choice(("u", "u", None)), rng.choice(("a", "bb", "cé😀", None, ""))))
    return [(c, 10 * i + (t or 0), r, x) for i, (c, t, r, x) in enumerate(rows)]  # no ties


def got_of(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = made_up(rng, [*range(60), *range(100, 140), *range(205, 215)])
    rows += [(5, None, "u", "null turn"), (None, 1, "u", "no conversation"), (300, 1, "u", "x" * 5000)]
    same = [(c, k, "u", t) for c in range(400, 440) for k, t in enumerate(("one", "two", "three"))]
    rows += same
    frame = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(3)
    convs = grouped(rows)
    turns = prefixes.turns_of(frame)
    assert got_of(prefixes.trie(*prefixes.as_they_are(turns))) == brute(convs)
    assert got_of(prefixes.trie(*prefixes.rebuilt(turns))) == brute(with_heads(convs))


def test_many_equal_conversations_span_blocks(spark):
    rows = [(c, k, "u", t) for c in range(-3000, 3000) for k, t in enumerate(("one", "two"))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["depth"]): r for r in prefixes.trie(*prefixes.as_they_are(prefixes.turns_of(frame))).collect()}
    ends = sha256(",".join(map(str, range(-3000, 3000))).encode()).hexdigest()
    assert set(got) == {(-3000, d) for d in range(3)} and got[-3000, 2]["ends_sha256"] == ends
    assert (got[-3000, 0]["saved_tokens"], got[-3000, 2]["saved_tokens"], got[-3000, 0]["n_leaves"]) == (5999 * 6, 5999 * 3, 1)


def test_ties_repeated_rows_and_an_empty_table(spark, tmp_path):
    rows = [(1, 1, "u", "b"), (1, 1, "u", "a"), (1, 1, "u", "a"), (2, 1, "u", "a"), (2, 1, "u", "b"), (2, 1, "u", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = got_of(prefixes.trie(*prefixes.as_they_are(prefixes.turns_of(frame))))
    assert sorted((r[1], r[3]) for r in got) == [(d, 2) for d in range(4)]  # ties come in one order
    assert prefixes.trie(*prefixes.rebuilt(prefixes.turns_of(frame.limit(0)))).count() == 0


def test_query_equals_its_sql_and_brute_force(spark, tmp_path):
    got, want = both(prefixes.op12_prefix_trie(spark, SF), prefixes.OP12_SQL, SF)
    assert got == want and len(got) > 100
    rows = made_up(random.Random(6), [*range(40), *range(100, 120)])
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(("conv_id", "turn", "role", "text"))})
    pa.parquet.write_table(table, tmp_path / "conversations.parquet")
    frame = prefixes.op12_prefix_trie(spark, str(tmp_path))
    got, want = both(frame, prefixes.OP12_SQL, conversations=table)
    assert got == want and got_of(frame) == brute(with_heads(grouped(rows)))
