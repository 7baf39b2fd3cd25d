"""Operator 3: quality classifier on random-indexing word vectors.

Every word form falls into one of a fixed number of buckets with a sparse ternary index vector. One pass over
all documents adds up, for each bucket, the index vectors of the words near it; the table of sums has a fixed
size, is summed by Spark in two levels and broadcast. A document pools the vectors of its words (mean, and mean
absolute step from word to word) and a two-layer numpy network scores it; a temperature fitted on rows kept out
of the training makes the scores probabilities. The network is fitted on at most ``max_labelled`` labelled rows
(those whose hashed ids are least); word vectors come from all documents.

Null and empty texts pool to zero and get the score of the network there; rows with a null label or null
doc_id teach nothing; without labels of both kinds every score is their share, or 0.5 without any. Repeated rows
are scored alike and teach once; an empty table gives an empty result; other columns pass through, whatever their
names; long texts are read whole, in parts of CHUNK tokens.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import crc_mod, documents, keyed, mapped_texts, pieces

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS, DIM, NONZERO, REACH = 8192, 32, 4, 2
GROUP = 128  # buckets in a row of the exchanged sums
CHUNK = 1 << 17  # tokens handled at once
CACHE_WORDS = 300_000
HIDDEN, EPOCHS, MAX_LABELLED = 32, 150, 10_000


class Buckets(dict):
    """word -> bucket, for one task: workers live longer than tasks, and what one keeps stays in its memory through all later stages."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return found

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, WORD.findall(text)), np.int32)


_buckets = Buckets()  # outside tasks


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, the same in every process."""
    rng, out = np.random.default_rng(20), np.zeros((BUCKETS, DIM), np.float32)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.float32), 1)
    return out


def sequences(texts, buckets: Buckets):
    """Chunks of about CHUNK tokens, as the buckets of each text's tokens; a long text may go on in the next chunk, which repeats its last tokens."""
    held, size = [], 0
    for text in texts:
        ids = buckets.ids(text)
        for at in range(0, len(ids), CHUNK):
            part = ids[max(0, at - REACH) : at + CHUNK]
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def context_sums(batches):
    """Sums of near index vectors over the rows of a task, as rows of GROUP buckets."""
    vectors, sums = index_vectors().astype(np.int8), np.zeros((BUCKETS, DIM), np.float64)  # whole numbers, the same in any order
    buckets = Buckets()
    for b in pieces(batches):
        for held in sequences(b.column(0).to_pylist(), buckets):
            ids, text = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
            own = vectors[ids]
            near = np.zeros_like(own)  # of each token, 2 * REACH vectors of -1 to 1 at most
            for step in range(1, REACH + 1):
                same = (text[step:] == text[:-step])[:, None]
                near[:-step] += own[step:] * same
                near[step:] += own[:-step] * same
            order = np.argsort(ids.astype(np.uint16), kind="stable")  # of 16 bits: a radix sort
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            sums[ids[order[first]]] += np.add.reduceat(near[order], first, dtype=np.int32)
    block, rows = TaskContext.get().partitionId(), sums.reshape(-1, GROUP * DIM)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array([block % 64] * len(used), pa.int32()), pa.array([r.tobytes() for r in rows[used]], pa.binary())], ["part", "salt", "sums"])


def add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(GROUP * DIM, np.float64)
    for x in table.column("sums"):
        total += np.frombuffer(x.as_buffer(), np.float64)
    return pa.table({"part": table.column("part").slice(0, 1), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the whole corpus: BUCKETS x DIM, whatever its size."""
    schema = "part int, salt int, sums binary"
    sums = docs.select("text").mapInArrow(context_sums, schema)
    for keys in (["part", "salt"], ["part"]):
        sums = sums.groupBy(*keys).applyInArrow(add_up, schema)
    out = np.zeros((BUCKETS // GROUP, GROUP * DIM), np.float32)
    for r in sums.collect():
        out[r["part"]] = np.frombuffer(r["sums"], np.float64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def pooled(texts: list[str], vectors: np.ndarray, buckets: Buckets = _buckets) -> np.ndarray:
    """One row for each text: mean vector, mean absolute step, log of the length. No more than a text's own vectors are held at once."""
    n = len(texts)
    mean, step, count = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n)
    for k, text in enumerate(texts):
        ids = buckets.ids(text)
        count[k] = len(ids)
        for at in range(0, len(ids), CHUNK):
            v = vectors[ids[max(0, at - 1) : at + CHUNK]]  # from the last token before on
            mean[k] += v[at > 0 :].sum(0)
            d = v[1:] - v[:-1]
            step[k] += np.abs(d, out=d).sum(0)
    return np.hstack([mean / np.maximum(count, 1)[:, None], step / np.maximum(count - 1, 1)[:, None], np.log1p(count)[:, None]]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A two-layer network by Adam on four fifths of the rows, and a temperature on the rest."""
    if len(np.unique(y)) < 2:
        return {"share": np.float64(y.mean() if len(y) else 0.5)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mu, sd = x[used].mean(0), x[used].std(0) + 1e-6
    x = (x - mu) / sd
    p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 1024)):
            h = np.tanh(x[part] @ p["w1"] + p["b1"])
            e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[part]) / len(part)
            back = np.outer(e, p["w2"]) * (1 - h * h)
            g = {"w1": x[part].T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * p["w2"], "b2": e.sum(keepdims=True)}
            t += 1
            for k in p:
                m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    model = {k: v.astype(np.float32) for k, v in p.items()} | {"mu": mu, "sd": sd}
    z = logits(x[held] * sd + mu, model) if len(held) else np.zeros(0)
    loss = lambda T: float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -z, z) / T))) if len(held) else 0.0
    return model | {"temperature": np.float64(min(np.geomspace(0.25, 8, 61), key=loss))}


def logits(x: np.ndarray, model) -> np.ndarray:
    return np.tanh(((x - model["mu"]) / model["sd"]) @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]


def probability(x: np.ndarray, model) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), float(model["share"]))
    return 1 / (1 + np.exp(-np.clip(logits(x, model) / model["temperature"], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_labelled: int) -> DataFrame:
    """doc_id, text and label of at most max_labelled rows; the bound makes the labels fit for broadcast. Of rows that share an id the least text counts."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "score", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and the score as column `name`; labels: doc_id and quality of the rows to learn from."""
    known = keyed(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(known))
    buckets = Buckets()  # each task gets an empty copy

    def features(batches):
        for b in pieces(batches):
            x = pooled(b.column(0).to_pylist(), vectors.value, buckets)
            yield pa.record_batch([b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    rows = labelled(known, labels, "quality", max_labelled).select("text", "label").mapInArrow(features, "label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["label"], bytes(r["x"])))  # the same model whatever order rows come in
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * DIM + 1)
    model = context.broadcast(train(x, np.array([r["label"] for r in rows], np.float64)))
    return mapped_texts(docs, name, DoubleType(), lambda texts: probability(pooled(texts, vectors.value, buckets), model.value), text_col)


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs."""
    return with_quality(keyed(docs, id_col, text_col), labels, "score", max_labelled)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score_quality(documents(spark, sf_dir), labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
