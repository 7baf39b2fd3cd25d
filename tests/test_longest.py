import random

from pyspark.sql import functions as F

from strataline.operators import graph
from strataline.operators.longest import longest_known


def brute(names, known, mark):
    split = lambda x: [p for p in x.split(mark) if p]
    held = {tuple(split(k)) for k in known if k is not None}
    out = {}
    for n in names:
        parts = split(n) if n is not None else []
        for d in range(len(parts), -1, -1):
            if n is not None and tuple(parts[:d]) in held:
                out[n] = mark.join(parts[:d])
                break
    return out


def test_longest_known_both_ways(spark):
    rng = random.Random(5)
    word = lambda: ".".join(rng.choice(["a", "b", "c", ""]) for _ in range(rng.randrange(1, 6)))
    for root in (False, True):
        names, known = [word() for _ in range(300)] + [None, "", "a" * 5000], [word() for _ in range(40)] + [None, "a.b", "a.b"]
        known = [k for k in known if k is None or k.strip(".")] + ([""] if root else [])
        for mark in (".", "/"):
            asked, held = [n and n.replace(".", mark) for n in names], [k and k.replace(".", mark) for k in known]
            want = brute(asked, held, mark)
            for most in (1 << 20, 0):
                rows = longest_known(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame([(k,) for k in held], "name string"), mark, most).collect()
                assert len(rows) == len(want) and {r["name"]: r["prefix"] for r in rows} == want


def test_longest_known_of_nothing(spark):
    some, none = spark.createDataFrame([("a.b",)], "name string"), spark.createDataFrame([], "name string")
    for most in (1 << 20, 0):
        assert longest_known(some, none, ".", most).isEmpty() and longest_known(none, some, ".", most).isEmpty()


def test_from_package_import_names(spark):
    files = {"src/pkg/__init__.py": "", "src/pkg/a.py": "from . import b, missing", "src/pkg/b.py": "x = 1", "main.py": "from pkg import a, b\nimport pkg.a.deep\nimport os, os.path"}
    _, edges = graph.from_source(spark, spark.createDataFrame(list(files.items()), "path string, source string"))
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    # of a statement the first name that is known counts
    assert got == {("src/pkg/a.py", "src/pkg/b.py"), ("main.py", "src/pkg/a.py")}


def test_small_tries_need_no_shuffle_of_levels(spark):
    names, known = spark.range(100).select(F.concat(F.lit("a.b"), "id").alias("name")), spark.createDataFrame([("a",), ("a.b1",)], "name string")
    plan = longest_known(names, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan and plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
