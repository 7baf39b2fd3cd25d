import numpy as np

from strataline.llm import hamming

from .oracle import both

SF = "/root/testdata/sf0.1"


def brute(codes, queries, k):
    out = set()
    for q in queries:
        far = sorted((int(codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:k]
        out |= {(q, i, d, n) for n, (d, i) in enumerate(far, 1)}
    return out


def rows_of(frame):
    return {(r["query_id"], r["neighbor_id"], r["distance"], r["rank"]) for r in frame.collect()}


def test_random_codes_end_by_radius(spark, monkeypatch):
    """Codes without structure: small tiles, so that blocks and tiles are several."""
    codes = [int(x) for x in np.random.default_rng(7).integers(0, 1 << 63, 2000)]
    monkeypatch.setattr(hamming, "TILE", 300)
    frame = spark.createDataFrame(list(enumerate(codes)), "vec_id long, code long")
    rounds = []
    got = rows_of(hamming.nearest(frame, frame.where("vec_id % 50 = 0"), k=10, rounds=rounds))
    assert got == brute(codes, range(0, 2000, 50), 10)
    assert sum(rounds) == 40 and len(rounds) < 8  # each query ended by a radius that covers its last distance, well before all bits


def test_ids_that_repeat_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0] * 64, 0), (1, [-1.0] * 64, 0), (2, [1.0] * 63 + [nan], 0), (3, [1.0, None] * 32, 0), (4, [], 0), (None, [1.0], 0), (5, None, 0), (2, [1.0] * 63 + [nan], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int").repartition(2)
    codes = hamming.codes_of(frame)
    got = rows_of(hamming.nearest(codes, codes.where("vec_id = 2"), k=5))
    assert {r[1:3] for r in got} == {(1, 1), (3, 31), (1, 63), (4, 63)}
    try:
        hamming.codes_of(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")).collect()
    except Exception as e:
        assert "more than 64" in str(e)
    else:
        raise AssertionError("65 components pass")


def test_query_equals_its_sql(spark):
    got, want = both(hamming.op4_topk_hamming(spark, SF), hamming.OP4_SQL, SF)
    assert got == want and len(got) == 400
