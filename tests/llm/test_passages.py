import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import passages
from strataline.llm.common import Tables

from .conftest import SCHEMA, rows

SF = "/root/testdata/sf0.01"


def brute(texts, window=50):
    """(doc_id, words, removed, kept) of each row; a null id is the smallest."""
    rank = lambda i: (i is not None, i or 0)
    split, first = [((t or "").encode().split()) for _, t in texts], {}
    for (i, _), words in zip(texts, split, strict=True):
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = Counter()
    for (i, _), words in zip(texts, split, strict=True):
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < rank(i):
                gone[s : s + window] = True
        out[i, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()] += 1
    return out


def got_of(frame):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect())


@pytest.fixture(scope="module")
def shared(words):
    """Documents with passages, edited copies of one text, and windows that begin and end in all ways."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base, out = say(75), say(180).split(), []
    for k in range(40):
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = say(1)
        out.append((1000 + k, "  ".join(edited)))
    for k in range(25):
        out.append((2000 - k, f"{say(rng.randint(0, 30))}\t{passage}\n{say(rng.randint(0, 30))}"))
        at, n = rng.randrange(60), rng.randint(48, 60)
        out.append((3000 + k, f"{say(5)} {' '.join(base[at : at + n])} {say(rng.randint(0, 4))} {' '.join(base[at + 10 : at + 10 + n])}"))
    out += [(4000, " ".join(["same"] * 130)), (4001, " ".join(["same"] * 49)), (4002, " ".join(["same", "other"] * 60)), (4003, " ".join(["same"] * 51)), (4004, f"{passage}\xa0{passage}"), (4005, say(50)), (4005, say(50))]
    return out


def test_against_brute_force(spark, docs, texts, shared, none):
    every = texts + shared
    frame = spark.createDataFrame(rows(every), SCHEMA).repartition(5)
    want = brute(every)
    assert got_of(passages.remove_passages(frame)) == want
    assert sum(r[2] > 0 for r in want) > 60
    assert passages.remove_passages(none).count() == 0


def test_hot_grams_are_split_with_the_same_result(spark, shared):
    frame = spark.createDataFrame(rows(shared), SCHEMA).repartition(4)
    assert got_of(passages.remove_passages(frame, crowd=4)) == brute(shared)
    t = Tables(spark)
    texts = t.write(frame.select(F.monotonically_increasing_id().alias("tid"), F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("body")))
    raw = passages.marked(texts)
    groups = raw.groupBy("gram", "ctx").count()
    hot = passages.hot_grams(texts, groups, groups.groupBy("gram").agg(F.count("*").alias("contexts")), 4, t)
    largest = lambda m: m.groupBy("gram").agg(F.count_distinct("ctx").alias("n")).agg(F.max("n")).first()[0]
    assert largest(raw) >= 20 and largest(passages.marked(texts, hot)) < largest(raw)  # what is left are parts of one text, at most 41 * 42 / 2 for each


def test_long_texts_in_parts(spark, words, monkeypatch):
    rng = random.Random(4)
    long = [rng.choice(words) for _ in range(700)]
    every = [(2, " ".join(long)), (1, " ".join(long[130:330])), (3, " ".join(long[:200] + ["x"] + long[201:]))]
    monkeypatch.setattr(passages, "CHUNK", 100)
    split = [t.split() for _, t in ((i, t.encode()) for i, t in every)]
    k, gram, ctx, start, end = passages.anchors(split)
    for j, words_of in enumerate(split):
        covered = {s for a, z in zip(start[k == j], end[k == j], strict=True) for s in range(a, z - 49)}
        assert covered == set(range(len(words_of) - 49))
    assert len({bytes(b" ".join(split[t][a:z])) for t, a, z in zip(k, start, end, strict=True)}) == len(set(zip(gram.tolist(), ctx.tolist(), strict=True)))


def test_index_against_its_definition():
    rng = np.random.default_rng(1)
    contexts = [rng.integers(0, 3, rng.integers(1, 60)) for _ in range(40)] + [np.zeros(50, np.int64)] * 2
    owners = rng.integers(0, 10, len(contexts)).astype(np.int32)
    holds = lambda c, part: any(np.array_equal(c[i : i + len(part)], part) for i in range(len(c) - len(part) + 1))
    for own, c, found in zip(owners, contexts, passages.FMIndex(contexts, owners).statistics(contexts, owners), strict=True):
        earlier = [x for x, o in zip(contexts, owners, strict=True) if o < own]
        for i in range(0, len(c), 3):
            best = 0
            while i + best < len(c) and any(holds(x, c[i : i + best + 1]) for x in earlier):
                best += 1
            assert found[i] == best


def test_wavelet_tree_counts():
    numbers = np.random.default_rng(2).integers(0, 37, 500)
    tree = passages.WaveletTree(numbers, 40)
    for at in (0, 1, 63, 64, 65, 300, 500):
        assert tree.count(np.arange(41), np.full(41, at)).tolist() == [int((numbers[:at] == c).sum()) for c in range(41)]


def test_query_on_a_whole_table(spark):
    frame = passages.op11_fm_index_passages(spark, SF)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in frame.collect())
    assert got == Counter((i, n, gone, sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(texts))
    assert sum(r[2] > 0 for r in got) > 20
