import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import embedding


def provider(texts):
    assert len(texts) <= embedding.BATCH
    return [np.array([[len(w), ord(w[0]), float("nan")] for w in t.split(" ") if w] or [[0.0, 0.0, 0.0]]) for t in texts]


def test_encode_in_order():
    texts = ["  a bb\n  ccc  ", None, "", "x" * 9, *("ab cd ef"[: k % 7 + 1] for k in range(20))]
    got = embedding.encode(texts, provider)
    for t, v in zip(texts, got, strict=True):
        m = np.nan_to_num(provider([embedding.normalised_text(t)])[0]).mean(0)
        assert np.allclose(v, m / np.linalg.norm(m) if m.any() else m)
    assert embedding.normalised_text("  a bb\n  ccc  ") == "a bb\nccc" and embedding.normalised_text(" \n") == " "
    with pytest.raises(ValueError, match="gave 1 embeddings for 2"):
        embedding.encode(["a", "b"], lambda texts: [np.ones((1, 2))])


def test_poolings():
    m = np.array([[1.0, -2.0], [3.0, 4.0], [2.0, 1.0], [0.0, 1.0]])
    want = {"cls": [1, -2], "mean": [1.5, 1], "max": [3, 4], "mean_sqrt_len": [3, 2], "last_token": [0, 1]}
    for name, v in want.items():
        assert np.allclose(embedding.encode(["t"], lambda _: [m], name)[0], np.array(v) / np.linalg.norm(v))
    assert np.allclose(embedding.encode(["t"], lambda _: [np.array([3.0, 4.0])], None)[0], [0.6, 0.8])


def test_columns(spark):
    rows = spark.createDataFrame([(k, "word " * (k % 5)) for k in range(30)], "id int, text string")
    got = embedding.with_embeddings(rows, lambda texts: [np.ones((1, 4)) * len(t) for t in texts])
    assert got.count() == 30 and got.where(F.abs(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) - 1) > 1e-9).isEmpty()
