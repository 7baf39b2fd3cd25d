import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from strataline.operators import duplication, graph, history, syntax
from strataline.sources import store, workspace

NOW = datetime(2026, 7, 13)


def log(spark, rows):
    """rows: (hash, email, ts, subject, {path: (added, deleted)})"""
    commits = spark.createDataFrame([r[:4] for r in rows], "hash string, email string, ts timestamp, subject string")
    touched = spark.createDataFrame([(r[0], p, str(a), str(d)) for r in rows for p, (a, d) in r[4].items()], "hash string, path string, added string, deleted string")
    return commits, touched


def test_history(spark):
    rows = [("a", "old@x", datetime(2000, 1, 1), "initial fix", {"t": (3, 0), "src/peer.py": (1, 0)}), ("b", "new@x", NOW, "fix branching bug", {"t": (1, 1), "src/peer.py": ("-", "-")})]
    got = history.history_metrics(*log(spark, rows), NOW).where("path = 't'").first()
    assert (got["contributors_count"], got["update_count"], got["recent_update_count"], got["historical_update_count"], got["recent_to_lifetime_update_ratio"]) == (2, 2, 1, 1, 0.5)
    assert (got["bug_fix_commit_count"], got["bug_fix_ratio"], got["co_change_file_count"], got["co_changed_sample"], got["churn_rate"]) == (1, 1.0, 1, ["src/peer.py"], 5)


def test_history_caps(spark):
    rows = [(f"{k:03}", "e", datetime(2020, 1, 1) + timedelta(days=k), "change", {"t": (1, 0), f"p{k}": (1, 0)}) for k in range(106)]
    got = history.history_metrics(*log(spark, rows), NOW).where("path = 't'").first()
    assert (got["commits_analyzed"], got["co_change_file_count"]) == (100, 100)
    bulk = [("a", "e", datetime(2020, 1, 1), "x", {"t": (1, 0)}), ("b", "e", datetime(2020, 1, 2), "x", {"t": (1, 0)} | {f"p{k}": (1, 0) for k in range(25)})]
    got = history.history_metrics(*log(spark, bulk), NOW).where("path = 't'").first()
    assert (got["co_change_file_count"], got["commits_analyzed"], got["bulk_commits_skipped"]) == (0, 1, 1)


def test_complexity_growth(spark):
    rows = spark.createDataFrame([("t", datetime(2020, 1, 1), 1.0), ("t", NOW, 2.0)], "path string, ts timestamp, average_cyclomatic_complexity double")
    assert history.complexity_growth(rows).first()["cyclomatic_complexity_growth_rate"] == 1.0


def test_imports_and_architecture(spark):
    files = {"src/pkg/consumer.py": "from pkg import service\nimport os", "src/pkg/service.py": "from .util import x", "src/pkg/util.py": "x = 1", "src/pkg/typed.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from pkg import consumer\nelse:\n    import missing\n"}
    nodes, edges = graph.from_source(spark, spark.createDataFrame(list(files.items()), "path string, source string"))
    got = {(r["src"], r["dst"]): r["is_runtime"] for r in edges.collect()}
    assert got == {("src/pkg/consumer.py", "src/pkg/service.py"): True, ("src/pkg/service.py", "src/pkg/util.py"): True, ("src/pkg/typed.py", "src/pkg/consumer.py"): False}
    rows = {r["node"].split("/")[-1]: r for r in graph.architecture_metrics(nodes, edges).collect()}
    assert [(rows[f]["fan_in"], rows[f]["fan_out"], rows[f]["transitive_dependents_count"], rows[f]["instability_index"]) for f in ("consumer.py", "service.py", "util.py")] == [(0, 1, 0, 1.0), (1, 1, 1, 0.5), (1, 0, 2, 0.0)]
    assert rows["service.py"]["betweenness_centrality"] == round(1 / 6, 6)


def test_strong_components(spark):
    rng = random.Random(8)
    for n, m in ((12, 16), (30, 45), (9, 40), (5, 0)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | ({(k, k + 1) for k in range(20, 26)} if n == 30 else set())
        reach = {(a, b) for a, b in pairs if a != b}
        while len(more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) > len(reach):
            reach = more
        want = {v: [w for w in range(n) if w != v and (v, w) in reach and (w, v) in reach] for v in range(n)}
        nodes, edges = spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(pairs), "src long, dst long")
        got = {r["node"]: (r["cycle_id"], r["circular_dependency_size"]) for r in graph.cycles(nodes, graph.all_edges(edges.withColumn("is_runtime", F.lit(True)))).collect()}
        assert got == {v: (min([v, *w]), len(w) + 1) if w else (None, 0) for v, w in want.items()}


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("c", "a", False), ("c", "d", True)], "src string, dst string, is_runtime boolean")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    got = {r["node"]: r for r in graph.architecture_metrics(nodes, edges).collect()}
    assert [got[x]["circular_dependency_size"] for x in "abcd"] == [3, 3, 3, 0] and not any(got[x]["runtime_circular_dependency_size"] for x in "abcd")
    members = graph.cycles(nodes, graph.all_edges(edges))
    (group,) = graph.cycle_groups(members, graph.all_edges(edges)).collect()
    assert group["nodes"] == ["a", "b", "c"] and [tuple(e) for e in group["edges"]] == [("a", "b"), ("b", "c"), ("c", "a")]


def test_betweenness_against_brute_force(spark):
    rng = random.Random(3)
    n = 9
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(22)}
    pairs = {(a, b) for a, b in pairs if a != b}

    def shortest(s, t):
        paths = [[s]]
        while paths:
            if hits := [p for p in paths if p[-1] == t]:
                return hits
            paths = [p + [b] for p in paths for a, b in pairs if a == p[-1] and b not in p]
        return []

    want = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        for t in range(n):
            if s != t and (found := shortest(s, t)):
                for v in range(n):
                    want[v] += v not in (s, t) and sum(v in p for p in found) / len(found)
    nodes = spark.createDataFrame([(str(k),) for k in range(n)], "node string")
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    got = {int(r["node"]): r["betweenness_centrality"] for r in graph.betweenness(nodes, edges).collect()}
    assert all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 2e-6 for v in want)


CLONE = "def {0}(items):\n    total = 0\n    for item in items:\n        if item > 3:\n            total += item * 2\n    return total\n"


def test_blocks_and_duplication(spark):
    files = {"a.py": CLONE.format("one"), "b.py": CLONE.format("two").replace("total", "result"), "c.py": "import os\n\nclass C:\n    x = 1\n", "bad.py": "def ("}
    sources = spark.createDataFrame(list(files.items()), "path string, source string")
    blocks = syntax.code_blocks(sources)
    assert {(r["path"], r["kind"]) for r in blocks.collect()} == {("a.py", "function"), ("b.py", "function")}
    paths = sources.select("path")
    got = {r["path"]: r for r in duplication.duplication_metrics(paths, blocks, None).collect()}
    assert (got["a.py"]["duplicate_blocks_count"], got["a.py"]["duplicate_loc_count"], got["a.py"]["duplication_group_size"], got["a.py"]["duplicate_file_candidates_count"]) == (1, 6, 2, 1)
    assert got["c.py"]["duplicate_blocks_count"] == 0 and got["a.py"]["semantic_duplicate_blocks_count"] is None
    whole = {r["path"]: r for r in duplication.duplication_metrics(paths, blocks, duplication.hashing_vectors(blocks)).collect()}
    assert whole["a.py"]["semantic_duplicate_blocks_count"] == 1 and abs(whole["a.py"]["max_similarity_score"] - 1) < 1e-6 and whole["c.py"]["max_similarity_score"] == 0.0


def test_near_tokens_against_difflib(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    lists = [base[:] for _ in range(12)]
    for k, x in enumerate(lists):
        for _ in range(k // 2):
            x[rng.randrange(len(x))] = rng.choice("abcdefghxyz")
    blocks = spark.createDataFrame([(f"f{k:02}", 0, x) for k, x in enumerate(lists)], "path string, block int, tokens array<string>")
    groups = duplication.token_groups(blocks)
    names = {r["gid"]: (r["first"]["path"], r["tokens"]) for r in groups.collect()}
    got = {(names[r["gid_a"]][0], names[r["gid_b"]][0]) for r in duplication.near_groups(groups).collect()}
    firsts = sorted(names.values())
    want = {(p, q) for i, (p, a) in enumerate(firsts) for q, b in firsts[i + 1 :] if SequenceMatcher(None, a, b, autojunk=False).ratio() >= duplication.SYNTAX_THRESHOLD}
    assert got == want


def test_static_metrics(spark):
    source = "# TODO debug\ndef f(a, b, *c):\n    if a and b and c:\n        return 1\n    elif a:\n        return 2\n    else:\n        try:\n            pass\n        except ValueError:\n            pass\n"
    rows = spark.createDataFrame([("m.py", source), ("bad.py", "def ("), ("two.py", "def g():\n    return 1\n")], "path string, source string")
    coverage = spark.createDataFrame([("m.py", 4, 1)], "path string, n_statements int, n_missing int")
    got = {r["path"]: r for r in syntax.static_metrics(rows, coverage).collect()}
    m = got["m.py"]
    assert (m["count_of_comments"], m["count_of_fixme_comments"], m["long_conditions_count"], m["max_if_else_chain_length"], m["average_parameters_count"], m["count_of_empty_except_blocks"], m["testing_coverage"]) == (1, 1, 1, 3, 3, 1, 75.0)
    assert m["max_cyclomatic_complexity"] == 6 and got["two.py"]["source_lines_of_code"] == 2 and got["two.py"]["testing_coverage"] == 0.0
    assert got["bad.py"]["lines_of_code"] is None and got["bad.py"]["errors"][0].startswith("Failed to parse file")


def test_store(spark):
    files = spark.createDataFrame([(1, "a", 10), (1, "b", 11)], "scan_id int, path string, file_id int")
    raw = spark.createDataFrame([(1, p) for p in (["a", "b"], ["a", "b"], ["b", "a"], ["a", "a"], ["a"], ["a", "zz"])], "scan_id int, pair array<string>")
    assert sorted((r[1], r[2]) for r in store.dependency_edges(files, raw).collect()) == [(10, 11), (11, 10)]
    groups = spark.createDataFrame([(1, 1, ["a", "b", "a", "unknown"]), (1, 2, ["a", "unknown"])], "scan_id int, group_id int, nodes array<string>")
    assert {(r["file_id"], r["size"]) for r in store.cycle_members(files, groups).collect()} == {(10, 2), (11, 2)}
    both = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "scan_id int, path string, peer string")
    assert [tuple(r) for r in store.co_change_edges(files, both).collect()] == [(1, 10, 11)]
    vectors = spark.createDataFrame([(1, "a", "static", {"x": float("nan"), "y": 1.0}, ["e"])], "scan_id int, path string, layer string, metrics map<string,double>, errors array<string>")
    got = {r["path"]: r for r in store.file_payloads(files, vectors).collect()}
    assert got["a"]["metrics"] == {"static": {"x": None, "y": 1.0}} and got["a"]["errors"] == {"static": ["e"]} and got["b"]["metrics"] == {}


def test_workspace(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".venv").mkdir()
    (tmp_path / "pkg/a.py").write_text("x = 1\n")
    (tmp_path / "pkg/b.py").write_bytes(b"\xff\xfe")
    (tmp_path / ".venv/c.py").write_text("")
    got = {r["path"]: r for r in workspace.read_sources(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/a.py", "pkg/b.py"} and got["pkg/a.py"]["source"] == "x = 1\n" and got["pkg/b.py"]["error"]
    missing = workspace.commit_log(spark, [str(tmp_path / "none")]).first()
    assert missing["error"] and missing["hash"] is None
