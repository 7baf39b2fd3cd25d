import random
import zlib
from collections import Counter
from hashlib import sha256
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataline.llm import automaton, packing, tokens, tokenstore

ODD = ["", "hello world", "I'll don't <|endoftext|> café ÀÉ ＡＢ ½ ǅ İI ΑΣ 日本語 text 123", "a" * 70, "   x é <|startoftext|><|endoftext|>", "the\x00 \x1c a\x85b", "👩‍👧 !!!???", "ß ẞ µ ª"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCAB))


def fuzz():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("abcdehinorstuäéñüß'.!#-0 12ßçœ日Ω<|>") for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_encoder_and_automaton_match_the_library(library):
    enc, words = tokens.encoder(), automaton.words_of()
    for text in fuzz():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want
        found = [words[w] for w in words.split(text)]
        assert np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist() == want
        assert " ".join(f[1] for f in found if f[1]) == library.decode(want, skip_special_tokens=False)


def test_automaton_on_small_merges():
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    made = automaton.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    assert made.encode("aaa") == [2, 0] and made.encode("aab") == [4] and made.encode("aaab") == [2, 3] and made.decode([4, 0]) == "aab a"


def test_documents(spark, docs, texts, none, library):
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in automaton.encode_documents(docs).collect())
    want = Counter((i, np.array(e, "<u4").tobytes(), library.decode(e, skip_special_tokens=False)) for i, t in texts for e in [library.encode(t or "", add_special_tokens=False).ids])
    assert got == want and automaton.encode_documents(none).count() == 0


def test_store_round_trip(spark, docs, texts, none, library, tmp_path):
    path = tokenstore.write_store(docs, str(tmp_path / "s"), parts=3, shard_bytes=2000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], sha256(r["ids"]).hexdigest()) for r in tokenstore.read_store(spark, path).collect())
    assert Counter((d, h) for _, d, _, h in got) == Counter((i, sha256(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()).hexdigest()) for i, t in texts)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [d for _, d, _, _ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    (one,) = tokenstore.read_store(spark, path, 53).collect()
    assert np.frombuffer(one["ids"], "<u4").tolist() == [*library.encode("one two", add_special_tokens=False).ids, 2]
    empty = tokenstore.write_store(none, str(tmp_path / "e"))
    assert tokenstore.read_store(spark, empty).count() == 0


def test_plan_against_bound():
    rng = random.Random(4)
    for capacity, n in ((10, 40), (64, 500), (2048, 3000)):
        counts = Counter(rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 3) for _ in range(n))
        bins, used = packing.plan(dict(counts), capacity), Counter()
        for times, inside in bins:
            assert sum(x for x, _ in inside) <= capacity
            for x, rank in inside:
                used[x] += times
                assert rank + times <= counts[x]
        assert used == counts
        need = -(-sum(k * c for k, c in counts.items()) // capacity)
        assert sum(t for t, _ in bins) <= need + max(1, need // 20)
    for gap in range(1, 41):  # the index against all choices
        counts = Counter(rng.randint(1, 40) for _ in range(12))
        found = packing.Sums(counts, 40).fill(gap)
        every = [c for k in (1, 2, 3) for c in combinations(sorted(counts.elements()), k) if sum(c) == gap]
        assert (found is None) == (not every) and (found is None or len(found) == len(every[0]) and tuple(sorted(found)) in every)
    assert packing.plan({}, 8) == [] and packing.plan({4: 3}, 8)


def test_exact_complements():
    assert [sorted(x for x, _ in inside) for _, inside in packing.plan({6: 1, 3: 1, 1: 1, 2: 2}, 10)] == [[1, 3, 6], [2, 2]]
    assert sum(t for t, _ in packing.plan({5: 1, 2: 1, 1: 1, 4: 1}, 6)) == 2


def test_pack(spark, docs, texts, none, library):
    got = packing.pack(docs, capacity=64).toPandas()
    size = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert got["length"].sum() == size
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    rows = got[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert Counter((None if i != i else int(i), *map(int, r)) for i, r in zip(got["doc_id"], rows, strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= -(-size // 64) + 2
    assert packing.pack(none).count() == 0
