import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from strataline.llm import exact, nearby, repeats
from strataline.llm.common import Tables
from strataline.llm.exact import LOWER


def lowered(text):
    return (text or "").encode().translate(LOWER)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((0, 100), (1, 1), (1, 1 << 47), (500, 1 << 40), (64, 64), (3000, 1 << 48)):
        values = np.unique(rng.integers(0, span, n)) if span > n else np.arange(n)
        assert exact.golomb_decode(exact.golomb_encode(values, span)).tolist() == values.tolist()


def test_exact(docs, texts, none):
    got = exact.deduplicate(docs, owners=4).collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[lowered(t)].append(i)
    want = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known, default=None), len(ids), sha256(body).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and len({r["text_sha256"] for r in kept}) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.deduplicate(none).count() == 0


def brute(texts, size, percent):
    sets = []
    for i, t in texts:
        w = lowered(t).split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:k]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def answer(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_near(docs, texts, none):
    for size, percent in ((3, 85), (5, 80)):
        assert answer(nearby.near_duplicates(docs, size, percent)) == brute(texts, size, percent)
    assert nearby.near_duplicates(none).count() == 0


@pytest.mark.parametrize("pairs_a_node", [0, 2])
def test_near_groups_of_many_variants(spark, words, monkeypatch, pairs_a_node):
    monkeypatch.setattr(nearby, "PAIRS_A_NODE", pairs_a_node)  # 0: hubs until no list spans two components
    rng = random.Random(9)
    long, short = [rng.choice(words) for _ in range(420)], [rng.choice(words) for _ in range(90)]
    passage, out = [rng.choice(words) for _ in range(40)], []
    for k in range(150):
        base = list((long, short)[k % 2])
        for _ in range(rng.choice((0, 1, 2, 4, 8, 16)) * (1 if k % 2 else 3)):
            base[rng.randrange(len(base))] = "".join(rng.choice("xyz") for _ in range(6))
        out.append((k, " ".join(base)))
    out += [(1000 + k, " ".join([rng.choice(words) for _ in range(rng.randint(2, 60))] + passage)) for k in range(60)]
    df = spark.createDataFrame(out, "doc_id long, text string")
    assert answer(nearby.near_duplicates(df, 3, 85)) == brute(out, 3, 85)


def test_lists_count_pairs_of_different_components(spark):
    lists = spark.createDataFrame([(0, 7, k, 9, 0) for k in range(100)] + [(0, 8, 1, 9, 1), (0, 8, 2, 9, 1)], "group long, value long, nid long, n long, pos long")
    assert {r["value"]: r["pairs"] for r in nearby.shared_lists(lists).collect()} == {7: 4950, 8: 1}
    roots = spark.createDataFrame([(k, 0) for k in range(97)], "nid long, root long")
    got = nearby.shared_lists(lists, roots).collect()  # 97 nodes of one component, and 3 others
    assert [(r["value"], r["main"], r["pairs"]) for r in got] == [(7, 0, 3 * 97 + 3)]


@pytest.mark.parametrize(("few", "pairs_a_node"), [(0, 0), (0, 2), (1 << 20, 2)])
def test_near_with_tables_that_are_few_or_many(spark, docs, texts, monkeypatch, few, pairs_a_node):
    monkeypatch.setattr(nearby, "FEW", few)
    monkeypatch.setattr(nearby, "PAIRS_A_NODE", pairs_a_node)
    assert answer(nearby.near_duplicates(docs, 3, 85)) == brute(texts, 3, 85)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 12)] + [(100, 101), (103, 101), (5, 50)]
    got = {r["nid"]: r["root"] for r in nearby.components(Tables(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(13), 50, 100, 101, 103} and {got[k] for k in (*range(13), 50)} == {0} and {got[k] for k in (100, 101, 103)} == {100}


def test_components_of_few_edges_take_few_shuffles(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    edges, number = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"), spark.sparkContext._jsc.sc().newShuffleId
    try:
        for name in names:
            spark.conf.set(name, "-1")  # sizes are unknown to Spark
        before = number()
        got = nearby.components(Tables(spark), edges)
        assert number() - before < 30
        assert {(r["nid"], r["root"]) for r in got.collect()} == {(k, 0) for k in range(41)}
    finally:
        for name in names:
            spark.conf.unset(name)


def removed(texts):
    n, seen = repeats.LENGTH, Counter()
    bodies = [(i, (t or "").encode()) for i, t in texts]
    for _, b in bodies:
        seen.update(b[k : k + n] for k in range(len(b) - n + 1))
    want = Counter()
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, sha256(kept).hexdigest()] += 1
    return want


def test_repeats(spark, docs, texts, none, words):
    got = lambda df: Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect())
    assert got(docs) == removed(texts) and repeats.remove_repeats(none).count() == 0
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.choice((150, 190, 199, 205, 260, 420)))) for _ in range(9)]
    many = [(k, "".join(rng.choice(("", "x", "yz", "".join(rng.choice("pqrs") for _ in range(rng.randint(1, 120))))) + rng.choice(parts) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    many.append((99, "ab" * 400))
    many += [(7, many[3][1]), (7, many[3][1]), (None, many[3][1]), *[(200, parts[5] + "tail" * 60)] * 30]
    assert got(spark.createDataFrame(many, "doc_id long, text string")) == removed(many)


def test_repeats_in_texts_above_a_chunk(spark, words):
    rng = random.Random(16)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, far = say(60), say(50)
    texts = [(1, say(180_000) + shared + say(90_000) + far + say(10)), (2, far + say(40)), (3, say(30) + shared)]
    assert len(texts[0][1]) > repeats.CHUNK and len(shared) > repeats.LENGTH < len(far)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, body, gone in ((1, texts[0][1], (shared, far)), (2, texts[1][1], (far,)), (3, texts[2][1], (shared,))):
        left = body
        for g in gone:
            left = left.replace(g, "")
        assert got[i]["n_spans"] == len(gone) and abs(len(left) - (got[i]["n_bytes"] - got[i]["n_removed"])) <= 4 * len(gone)


def test_merge_and_front_coding():
    rng = random.Random(3)
    runs, every = [], []
    for _ in range(5):
        items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))), b"", 0, k, 0, 0) for k in range(rng.randint(0, 30)))
        every += [x[0] for x in items]
        runs.append(repeats.decoded(repeats.front_coded(items, [7])))
    out, before = [], b""
    for key, known, fields in repeats.merged(runs):
        assert known == repeats.common(before, key) and fields[1] == 7
        out.append(key)
        before = key
    assert out == sorted(every)


def test_large_groups_agree_with_pairs():
    rng = random.Random(8)
    core = bytes(rng.choice(b"abc") for _ in range(120))
    items = []
    for k in range(20):
        right, left = core + bytes(rng.choice(b"de") for _ in range(80)), bytes(rng.choice(b"fg") for _ in range(40)) if k % 3 else b"f" * 40
        if k % 4 == 0:
            right = core + b"d" * 80
        items.append((b"\0" * 8 + right[: repeats.LENGTH], (left, 1, 50, 0, 40)))
    items.sort()
    keys, fields = [x[0] for x in items], [x[1] for x in items]
    shared = [0] + [repeats.common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    flat = lambda found: [sorted({d for a, z in spans for d in range(a, z + 1)}) for spans in found]
    assert flat(repeats.by_classes(keys, shared, fields)) == flat(repeats.repeated(keys, shared, fields)) and any(flat(repeats.repeated(keys, shared, fields)))
