"""Cosine pairs against all products."""

import numpy as np
import pytest

from strataline.operators import cosine


def clustered(rng, clusters, each, noise, d=16):
    centres = rng.normal(size=(clusters, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + noise * rng.normal(size=(each, d)) for c in centres])


def brute(v, files, t):
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    s = u @ u.T
    return {(i, j): float(s[i, j]) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= t and files[i] != files[j]}


def got_of(spark, v, files, t, **options):
    frame = spark.createDataFrame([(i, f, list(map(float, x))) for i, (f, x) in enumerate(zip(files, v, strict=True))], "id long, path string, embedding array<double>")
    return {(r["id_a"], r["id_b"]): r["similarity"] for r in cosine.semantic_matches(frame, t, **options).collect()}


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(3)
    v = clustered(rng, 10, 60, 0.02)
    v[5] = 0
    files = [str(k % 7) for k in range(len(v))]
    seen = []
    assert same(got_of(spark, v, files, 0.9, rows=25, seen=seen), brute(v, files, 0.9))
    assert seen[0][0] < seen[0][1] / 3


@pytest.mark.parametrize("t", [0.35, -1.0])
def test_vectors_without_structure(spark, t):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 8))
    v[100:140] = v[0]  # copies
    files = [str(k % 3) for k in range(150)]
    assert same(got_of(spark, v, files, t, rows=20), brute(v, files, t))


def test_defined_cases(spark):
    assert got_of(spark, np.zeros((0, 3)), [], 0.5) == {}
    assert got_of(spark, np.array([[1.0, 0], [2.0, 0]]), ["x", "y"], 0.5) == {(0, 1): 1.0}
    with pytest.raises(Exception, match="differ in length"):
        got_of(spark, [[1.0, 0.0], [1.0]], ["x", "y"], 0.5)
