"""Operator 5: toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Units are the words of a sentence, letters only, so that marks put between letters vanish; three or more
single letters in a row form one unit. The kernel counts common subsequences of three letters, gaps allowed,
each weighted by LAMBDA to the power of its span, and is normalised, so a word with inserted, dropped or
stretched letters stays close to the plain one. Landmarks are units that mark toxic sentences and units of
clean ones; a linear machine on the Nyström features learns from sentences, taking of each toxic document's
sentences the units that score highest (three rounds). As the decision is linear in the kernel, it is folded
into one weight for each subsequence, and a worker scores each distinct unit once. A sentence scores as its
highest unit, a document as its highest sentence; a logistic fit on the training documents makes that a
probability. The model is fitted on at most ``max_labelled`` labelled rows.

Null and empty texts have no unit and get the lowest score; rows with a null label or doc_id teach nothing;
without labels of both kinds every score is their share, or 0.5 without any. Repeated rows are scored alike and
teach once; an empty table gives an empty result; columns other than the id and the text are ignored, whatever
their names; texts of any length are read whole. Letters beyond a-z and the western accented ones share three
symbols, so units in other scripts are told apart by their shape alone.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, keyed, pieces
from .quality import labelled

LAMBDA, SPAN, LONGEST = 0.7, 6, 24
LANDMARKS, ROUNDS, MAX_LABELLED = 128, 3, 3_000
#: Share of documents that are marked toxic without a unit that tells, as the logistic fit takes it.
UNEXPLAINED = 0.02
#: Units whose features are widened to doubles at once.
BLOCK_UNITS = 16_384
CACHE_UNITS = 300_000
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
TOKEN = re.compile(r"\S+")
MARKS = re.compile(r"[\W\d_]+")
COUNTS = re.compile(r"[\d_]")
SYMBOLS = 64
#: Letters to symbols: a-z 1-26, 27 and 28 the start and the end of a unit, the western accented ones 29-60, all others by their code.


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else ord(c) - 194 if "ß" <= c <= "þ" else 61 + ord(c) % 3


def gapped(words: list[str], bare: list[str]) -> list[str]:
    """Runs of three or more words of one letter, joined; words of marks alone lie inside a run, digits end it."""
    out, run, last = [], [], -2
    for k in [k for k, w in enumerate(bare) if len(w) < 2 and not COUNTS.search(words[k])]:
        if k != last + 1:
            if len(run) > 2:
                out.append("".join(run))
            run = []
        last = k
        if bare[k]:
            run.append(bare[k])
    return [*out, "".join(run)] if len(run) > 2 else out


def units(text: str) -> list[str]:
    """Words without marks, and rows of single letters joined; cut to windows of LONGEST letters where longer."""
    words = text.lower().split()
    out = [MARKS.sub("", w) if not w.isalpha() else w for w in words]
    out += gapped(words, out)
    return [p for w in out if w for p in ([w] if len(w) <= LONGEST else [w[k : k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2)])]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (0: none) and weights of words, sorted in each row, equal codes summed at their first place."""
    width = max(map(len, words)) + 2
    x = np.zeros((len(words), width + SPAN), np.int32)
    for r, w in enumerate(words):
        x[r, 0] = 27
        x[r, 1 : len(w) + 2] = [*map(symbol, w), 28]
    found, weight = [], []
    for i in range(width):
        for k in range(i + 2, min(i + SPAN, width)):
            for j in range(i + 1, k):
                c = (x[:, i] << 12 | x[:, j] << 6 | x[:, k]) * (x[:, k] > 0)
                found.append(c)
                weight.append(LAMBDA ** (k - i + 1))
    c, w = np.array(found, np.int32).reshape(-1, len(words)).T, np.array(weight, np.float32)
    return c, np.broadcast_to(w, c.shape) * (c > 0)


def norms(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors: equal codes of a row are one feature."""
    order = np.argsort(c, axis=1)
    c, w = np.take_along_axis(c, order, 1), np.take_along_axis(w, order, 1)
    flat, first = w.ravel(), np.ones(c.shape, bool)
    first[:, 1:] = c[:, 1:] != c[:, :-1]
    sums = np.add.reduceat(flat, np.flatnonzero(first.ravel())) if flat.size else flat
    rows = np.repeat(np.arange(len(c)), first.sum(1))
    return np.sqrt(np.bincount(rows, sums.astype(np.float64) ** 2, len(c)))


def grouped(words):
    """Words of about one length together, in parts of bounded size."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        to = min(at + 4096, len(words))
        while to > at + 1 and len(words[to - 1]) > len(words[at]) + 3:
            to = at + max(1, (to - at) // 2)
        yield words[at:to]
        at = to


def decide(words: list[str], weights: np.ndarray) -> np.ndarray:
    c, w = codes(words)
    return (weights[c] * w).sum(1) / np.maximum(norms(c, w), 1e-9)


def disguised(word: str) -> list[str]:
    """The word with a letter doubled, and with a letter that is rare put in, at each inner place."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in (word[k], "xzq"[k % 3])] if len(word) >= 4 else []


def dense(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences that a few words have, and the normalised feature vectors of the words over these."""
    own = [codes([word]) for word in words]
    used = np.unique(np.concatenate([np.zeros(1, np.int32), *(c[0] for c, _ in own)]))
    out = np.zeros((len(words), len(used)), np.float32)
    for r, (c, w) in enumerate(own):
        np.add.at(out[r], np.searchsorted(used, c[0]), w[0])
        out[r] /= max(np.linalg.norm(out[r]), 1e-9)
    return used, out


def fit_svm(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> np.ndarray:
    """Weights and bias of the squared-hinge machine on rows of z, by Newton steps on those inside the margin, summed over blocks."""
    u, ridge = np.zeros(z.shape[1] + 1), np.eye(z.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(u))
        for at in range(0, len(rows), BLOCK_UNITS):
            part = slice(at, at + BLOCK_UNITS)
            x = np.ones((len(rows[part]), len(u)))
            x[:, :-1] = z[rows[part]]
            inside = y[part] * (x @ u) < 1
            x = x[inside]
            a = x * (c * weight[part][inside])[:, None]
            left += a.T @ x
            right += a.T @ y[part][inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, u, atol=1e-6):
            break
        u = 0.5 * u + 0.5 * new if _ > 20 else new
    return u


def train(rows: list[tuple[str, int]], seed: int = 5) -> dict:
    """rows: (text, label). Gives the weight of each subsequence, the bias and the logistic fit."""
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(rows) else 0.5}
    docs = [([sorted(set(map(sys.intern, units(s)))) for s in SENTENCE.split(t)], y) for t, y in rows]
    docs = [([s for s in sentences if s], y) for sentences, y in docs]
    seen = [Counter(u for sentences, y in docs if y == k for u in {x for s in sentences for x in s}) for k in (0, 1)]
    n = [int((labels == k).sum()) for k in (0, 1)]
    odds = {u: min(c, 50) ** 0.5 * np.log(((c + 0.1) / (n[1] + 1)) / ((seen[0][u] + 0.5) / (n[0] + 1))) for u, c in seen[1].items() if c >= 2}
    rng = np.random.default_rng(seed)
    marked = sorted(odds, key=lambda u: (-odds[u], u))
    clean = sorted(seen[0])
    landmarks = list(dict.fromkeys([*marked[: LANDMARKS * 3 // 4], *(clean[k] for k in rng.permutation(len(clean))[: LANDMARKS // 4])]))
    used, phi = dense(landmarks)
    column = np.zeros(SYMBOLS**3, np.int32)  # of a subsequence in phi; those that no landmark has share the first, empty one
    column[used] = np.arange(len(used))
    gram = phi @ phi.T
    lam, vec = np.linalg.eigh(gram)
    root = vec @ np.diag(np.where(lam > 1e-4, np.maximum(lam, 1e-4) ** -0.5, 0)) @ vec.T

    twins = {u: disguised(u) for u in marked[: LANDMARKS * 3 // 4]}
    every = sorted({u for sentences, y in docs if y == 1 for s in sentences for u in s} | set(clean) | {v for vs in twins.values() for v in vs})
    place = {u: k for k, u in enumerate(every)}
    z = np.zeros((len(every), len(landmarks)), np.float32)
    table, narrow = np.ascontiguousarray(phi.T), root.astype(np.float32)
    for part in grouped(every):
        for at in range(0, len(part), 512):
            c, w = codes(part[at : at + 512])
            k = np.zeros((len(c), len(landmarks)), np.float32)
            for t in range(c.shape[1]):
                k += table[column[c[:, t]]] * w[:, t, None]
            z[[place[u] for u in part[at : at + 512]]] = (k / np.maximum(norms(c, w), 1e-9)[:, None]).astype(np.float32) @ narrow
    negatives = np.array([place[u] for u in clean])
    score = np.array([odds.get(u, 0.0) - 0.2 * seen[0][u] for u in every])
    sure = np.array([u in odds and seen[1][u] >= 5 and not seen[0][u] and odds[u] >= 0.5 * max(odds.values()) for u in every])
    toxic = [[np.array([place[u] for u in s]) for s in sentences] for sentences, y in docs if y == 1 and sentences]
    for _ in range(ROUNDS):
        best = []
        for sentences in toxic:
            inside = np.unique(np.concatenate(sentences))
            high = score[inside].max()
            best += inside[(score[inside] >= (min(0.5 * high, 1) if high > 0 else high)) | sure[inside]].tolist()
        times = Counter(int(b) for b in best if seen[0][every[b]] <= 0.2 * seen[1][every[b]])
        for b in [*times]:  # disguises of what is found are toxic too
            for v in twins.get(every[b], ()):
                if v not in seen[0]:
                    times[place[v]] += times[b] / 60
        positives = np.array(sorted(times))
        if not len(positives):
            return {"share": float(labels.mean())}
        chosen = np.setdiff1d(negatives, positives)
        y = np.r_[np.ones(len(positives)), -np.ones(len(chosen))]
        by = np.r_[[times[int(p)] for p in positives], np.array([seen[0][every[k]] for k in chosen]) ** 0.5]
        u = fit_svm(z, np.r_[positives, chosen], y, by / by.sum() * len(by))
        score = np.concatenate([z[at : at + BLOCK_UNITS] @ u[:-1] for at in range(0, len(z), BLOCK_UNITS)]) + u[-1]
    weights = np.zeros(SYMBOLS**3, np.float32)
    weights[used] = phi.T @ (root @ u[:-1])
    by_unit: dict[str, float] = {}
    for part in grouped({x for sentences, _ in docs for s in sentences for x in s}):
        by_unit.update(zip(part, (decide(part, weights) + u[-1]).tolist(), strict=True))
    top = np.array([max((by_unit[x] for s in sentences for x in s), default=-3.0) for sentences, _ in docs])
    a, b = 3.0, 0.0
    for _ in range(400):  # logistic fit of the documents' highest scores; a share UNEXPLAINED of toxic labels owes nothing to them
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        e = np.where(labels == 1, (1 - UNEXPLAINED) * p * (1 - p) / (UNEXPLAINED + (1 - UNEXPLAINED) * p), -p)
        s = p * (1 - p) + 1e-6
        h = np.array([[np.sum(s * top * top) + 1e-2, np.sum(s * top)], [np.sum(s * top), np.sum(s) + 1e-2]])
        d = np.linalg.solve(h, [np.sum(e * top) - 1e-2 * (a - 3), np.sum(e)])
        a, b = a + 0.2 * d[0], b + 0.2 * d[1]
    return {"weights": weights, "bias": float(u[-1]), "a": float(a), "b": float(b), "lowest": -3.0}


_scores: dict[str, float] = {}
_scored_for: list[object] = [None]


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    if _scored_for[0] is not model:
        _scored_for[0] = model
        _scores.clear()
    top = np.full(len(texts), model["lowest"])
    at = 0
    while at < len(texts):
        to, size, split = at, 0, []
        while to < len(texts) and size < 1 << 21:
            split.append(units(texts[to]))
            size += len(texts[to])
            to += 1
        if len(_scores) >= CACHE_UNITS:
            _scores.clear()
        for part in grouped({u for s in split for u in s if u not in _scores}):
            _scores.update(zip(part, (decide(part, model["weights"]) + model["bias"]).tolist(), strict=True))
        for k, s in enumerate(split):
            if s:
                top[at + k] = max(map(_scores.__getitem__, s))
        at = to
    return 1 / (1 + np.exp(-np.clip(model["a"] * top + model["b"], -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs; labels: doc_id and toxic of the rows to learn from."""
    docs = keyed(docs, id_col, text_col)
    rows = labelled(docs, labels, "toxic", max_labelled).select("text", "label").collect()
    model = docs.sparkSession.sparkContext.broadcast(train(sorted((r["text"], r["label"]) for r in rows)))

    def scores(batches):
        for b in pieces(batches):
            yield pa.record_batch([b.column(0), pa.array(score_texts(b.column(1).to_pylist(), model.value), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(scores, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score_toxicity(documents(spark, sf_dir), labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
