from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from strataline.llm import infill

from .oracle import both

SF = "/root/testdata/sf0.001"
ODD = ["", "a", "ab", "x<P>y", "<S>", "a<M", "<P<S<M>", "<", "日本語 text\n", "👩‍👧 é\U0001f600", "é́", "one two\n\n three", "\x00\x1c\x85", "é" * 3000]


def brute(text, doc_id):
    text = text or ""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    plain = not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return n, form, None if plain else low, None if plain else high - low, out


def test_rows_equal_brute_force_and_come_back(spark, docs, texts, none):
    got = infill.with_restored(infill.with_infill(docs)).collect()
    assert Counter((r["doc_id"], *r["infill"]) for r in got) == Counter((i, *brute(t, i)) for i, t in texts)
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((i, t or "") for i, t in texts)
    assert got[0].asDict().keys() >= {"score", "kept", "value"}  # clashing columns pass through
    assert infill.with_restored(infill.with_infill(none)).count() == 0
    assert set(infill.with_infill(docs.withColumn("infill", docs.tag)).columns) == {*docs.columns, "infill"}


def test_forms_round_trip():
    seen = Counter()
    for k, text in enumerate(ODD * 40):
        for unit in ("point", "word", "line"):
            n, form, low, mid, out = infill.transform(text, k, unit)
            assert infill.restored(out, form) == text
            if unit == "point":
                assert (n, form, low, mid, out) == brute(text, k)
            seen[form] += 1
    assert set(seen) == {"plain", "psm", "spm"}


def test_units():
    at = lambda text, unit: infill.boundaries(infill.points(text), unit).tolist()
    assert at("ab  c\n", "word") == [0, 2, 4, 5, 6] and at("a\n\nb", "line") == [0, 2, 3, 4] and at("a\n", "line") == [0, 2]
    assert at("", "word") == [0] and at("", "point") == [0] and at("日本", "point") == [0, 1, 2]
    with pytest.raises(ValueError):
        infill.boundaries(np.zeros(1, np.uint32), "page")


def test_query_equals_its_sql(spark, tmp_path):
    got, want = both(infill.op13_fill_in_middle(spark, SF), infill.OP13_SQL, SF)
    assert got == want and len(got) == 200
    odd = pa.table({"doc_id": pa.array([*range(len(ODD)), None, None], pa.int64()), "text": [*ODD, None, "null id"]})
    path = tmp_path / "documents.parquet"
    pa.parquet.write_table(odd, path)
    got, want = both(infill.op13_fill_in_middle(spark, str(tmp_path)), infill.OP13_SQL, documents=odd)
    assert got == want
