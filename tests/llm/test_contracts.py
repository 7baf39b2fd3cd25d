"""The registered queries' digests, on the odd texts, against other ways to the same columns."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataline.llm import registry, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("contracts")
    docs.write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.fixture(scope="module")
def encoded(texts):
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCAB))
    out = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in texts}
    return out, {t: library.decode(ids, skip_special_tokens=False) for t, ids in out.items()}


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def hexed(data):
    return sha256(data).hexdigest()


def made(spark, name, sf_dir, *columns):
    rows = registry.QUERIES[name](spark, sf_dir).select(*columns).collect()
    return Counter(tuple(r) for r in rows)


def test_op2(spark, sf_dir, texts, encoded):
    rows = registry.QUERIES["op2_token_store"](spark, sf_dir).collect()
    want = Counter((i, len(ids) + 1, zlib.crc32(packed([*ids, 2]))) for i, t in texts for ids in [encoded[0][t]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_op6(spark, sf_dir, texts, encoded):
    want = Counter((i, len(encoded[0][t]), hexed(packed(encoded[0][t])), hexed(encoded[1][t].encode())) for i, t in texts)
    assert made(spark, "op6_bpe_automaton", sf_dir, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def base_spans(text):
    assign = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    access = [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(assign + access + hexes, key=lambda s: (s[1], kinds.index(s[0])))


def test_op7(spark, sf_dir, texts):
    want, found = Counter(), 0
    for i, t in texts:
        spans = base_spans(t or "")
        found += len(spans)
        count = Counter(k for k, _, _ in spans)
        want[i, count["assign"], count["access"], count["hex"], hexed(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())] += 1
    rows = registry.QUERIES["op7_secret_scan"](spark, sf_dir).collect()
    assert found >= 4 and Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        base = [s for s in spans if not s.startswith("entropy:")]
        assert hexed(",".join(base).encode()) == r["base_sha256"]
    assert any("entropy:" in r["spans"] for r in rows if r["doc_id"] == 61)


def test_op8(spark, sf_dir, texts):
    bodies = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k : k + 200] for b in bodies for k in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(texts, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]))
        want[i, len(b), int(gone.sum()), runs, hexed(bytes(x for x, g in zip(b, gone, strict=False) if not g))] += 1
    assert made(spark, "op8_suffix_dedup", sf_dir, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op9(spark, sf_dir, texts):
    def shingled(text):
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()

    sets = [shingled(t) for _, t in texts]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = Counter()
    for k, (i, _) in enumerate(texts):
        c = least.get(top(k))
        want[i, len(sets[k]), c, i == c] += 1
    assert made(spark, "op9_minhash_near_dedup", sf_dir, "doc_id", "n_shingles", "component_id", "kept") == want


def test_op10(spark, sf_dir, texts, encoded):
    rows = registry.QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    want = Counter()
    for i, t in texts:
        ids = [*encoded[0][t], 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(packed(ids[k : k + 2048]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1
