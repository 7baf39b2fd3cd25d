import pytest
from pyspark.sql import functions as F

from strataline.functions import numeric, paths
from strataline.operators import scoring

HOT = dict(lines_of_code=520.0, source_lines_of_code=480.0, max_cyclomatic_complexity=18.0, max_cognitive_complexity=28.0, average_cyclomatic_complexity=9.0, average_cognitive_complexity=14.0, churn_to_size_ratio=7.0, update_count=30.0, recent_update_count=12.0, bug_fix_ratio=0.5, bug_fix_commit_count=8.0, co_change_file_count=12.0, duplicate_loc_count=120.0, duplicate_blocks_count=4.0, semantic_duplicate_blocks_count=3.0, duplication_group_size=5.0, duplicate_file_candidates_count=5.0, max_similarity_score=1.0, fan_out=10.0, fan_in=8.0, circular_dependency_size=4.0, runtime_circular_dependency_size=4.0, transitive_dependents_count=30.0, betweenness_centrality=0.05, instability_index=0.6)


def test_hot_above_calm_and_unknown_stays_unknown(spark):
    calm = {k: min(1.0, v) for k, v in HOT.items()}
    names = list(HOT)
    rows = spark.createDataFrame([("hot", *HOT.values()), ("calm", *calm.values()), ("none", *[None] * len(names))], "path string, " + ", ".join(f"{n} double" for n in names))
    got = {r["path"]: r for r in scoring.score_files(rows).collect()}
    assert got["hot"]["priority_band"] == "critical" and got["calm"]["refactor_score"] < got["hot"]["refactor_score"] <= 1
    assert got["none"]["refactor_score"] is None and got["none"]["priority_band"] is None and got["none"]["score_confidence"] == 0.0
    shares = [c["share"] for c in got["hot"]["contributions"]]
    assert shares == sorted(shares, reverse=True) and all(s > 0 for s in shares)
    done = scoring.summarise(scoring.score_files(rows), "path").first()
    assert (done["files_evaluated"], done["files_scored"], done["files_unscored"]) == (3, 2, 1) and done["top_candidates"][0] == "hot"


def test_semantic_metrics_unknown_keep_coverage(spark):
    row = {k: v for k, v in HOT.items() if k.startswith("dup") or k.endswith("lines_of_code")}
    got = scoring.score_files(spark.createDataFrame([tuple(row.values())], list(row))).first()
    assert got["duplication_score"] is not None and abs(got["duplication_coverage"] - 0.68) < 1e-9 and 0 < got["score_confidence"] < 1


def test_weights_are_checked(spark):
    for bad, word in (({"a": 1.0}, "missing scores"), ({"a": 0.5, "b": 0.5, "c": 0.0}, "unexpected scores"), ({"a": 0.5, "b": 0.4}, "sum to 1.0")):
        with pytest.raises(ValueError, match=word):
            scoring.checked(bad, {"a": 1, "b": 1})
    weights = {k: dict(v) for k, v in scoring.WEIGHTS.items()}
    del weights["complexity"]["size"]
    got = scoring.score_files(spark.createDataFrame([(1.0,)], ["fan_in"]), weights).first()
    assert got["complexity_score"] is None and got["refactor_score"] is None and len(got["decision_errors"]) == 1
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in scoring.WEIGHTS.values())


def test_clamp_and_numbers(spark):
    got = spark.createDataFrame([(None,), (-1.0,), (2.0,), (float("nan"),)], "x double").select(numeric.clamp(F.col("x")).alias("c"), numeric.number(F.col("x")).alias("n")).collect()
    assert [r["c"] for r in got[:3]] == [None, 0.0, 1.0] and got[3]["n"] is None


def test_paths(spark):
    rows = ["src/pkg/a.py", "a//b/c.py", "/abs.py", "x/../y.py", "c:\\a.py", "", "pkg\\m.py", "src/pkg/__init__.py"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select(paths.canonical(F.col("p")).alias("c"), paths.module_name(F.col("p")).alias("m"), paths.directory(F.col("p")).alias("d"), paths.language(F.col("p")).alias("l")).collect()
    assert [r["c"] for r in got] == ["src/pkg/a.py", "a/b/c.py", None, None, None, None, "pkg/m.py", "src/pkg/__init__.py"]
    assert got[0]["m"] == "pkg.a" and got[7]["m"] == "pkg" and got[0]["d"] == "src/pkg" and got[0]["l"] == "Python" and got[5]["l"] == "Unknown"
