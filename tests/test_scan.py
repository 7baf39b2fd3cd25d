import os
import random
import subprocess
from datetime import datetime
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strataline.operators import history
from strataline.plans import scan
from strataline.sources import gitlog, store, workspace

CODE = {
    "src/a.py": "from pkg import b\n\ndef f(x):\n    if x and x > 1 and x < 9:\n        return 1\n    return 2\n",
    "src/pkg/b.py": "import os\nX = 1\n",
    "src/broken.py": "def (:\n",
}


def git(repo, *args, at=1_700_000_000):
    """All commits of a test have one time unless told otherwise, so that only the log's own order tells them apart."""
    env = os.environ | {"GIT_AUTHOR_DATE": f"{at} +0000", "GIT_COMMITTER_DATE": f"{at} +0000"}
    subprocess.run(["git", "-C", str(repo), "-c", "user.email=a@x", "-c", "user.name=a", *args], check=True, capture_output=True, env=env)


def test_order_of_commits_of_one_second(spark, tmp_path):
    git(tmp_path, "init", "-q")
    for k in range(8):
        (tmp_path / "a.py").write_text(f"x = {k}\n")
        (tmp_path / f"p{k}.py").write_text("")
        git(tmp_path, "add", ".")
        git(tmp_path, "commit", "-qm", f"fix {k}")
    log = workspace.commit_log(spark, [str(tmp_path)], commits=3)
    assert log.select("ts").distinct().count() == 1
    assert {r["subject"]: r["pos"] for r in log.collect()} == {f"fix {k}": 7 - k for k in range(8)}
    assert gitlog.raw_log(spark, [str(tmp_path)], 3).rdd.getNumPartitions() == 3  # one repository, many tasks
    commits, touched = workspace.split_log(log)
    a = history.history_metrics(commits, touched, datetime(2024, 1, 1)).where("path = 'a.py'").first()
    assert (a["update_count"], a["bug_fix_commit_count"], a["commits_analyzed"]) == (8, 7, 7) and a["co_changed_sample"] == [f"p{k}.py" for k in range(1, 8)]
    newest = {r["peer"] for r in history.co_changes(commits, touched, newest=2).where("path = 'a.py'").collect()}
    assert newest == {"p6.py", "p7.py"}
    assert {r["path"]: r["source"] for r in workspace.first_versions(log).collect()}["a.py"] == "x = 0\n"
    both = workspace.commit_log(spark, [str(tmp_path), str(tmp_path / "none")])
    assert both.where("error is not null").count() == 1 and workspace.split_log(both, str(tmp_path))[0].count() == 8


def test_chains_of_renames_across_tasks(spark, tmp_path):
    """Names given on, taken over and used again, against the walk from the newest commit back."""
    rng, names = random.Random(4), ["a.py", "b.py", "c.py", "d.py"]
    git(tmp_path, "init", "-q")
    held = {}
    for k in range(40):
        free, used = [n for n in names if n not in held], sorted(held)
        kind = rng.choice(("new", "move", "move", "edit", "drop"))
        if kind == "new" and free or not used:
            n = rng.choice(free)
            held[n] = "".join(f"line {rng.random()}\n" for _ in range(30))
            (tmp_path / n).write_text(held[n])
        elif kind == "move" and free:
            n, to = rng.choice(used), rng.choice(free)
            held[to] = held.pop(n)
            git(tmp_path, "mv", n, to)
        elif kind == "drop" and len(used) > 1:
            held.pop(n := rng.choice(used))
            (tmp_path / n).unlink()
        else:
            n = rng.choice(used)
            held[n] += f"more {k}\n"
            (tmp_path / n).write_text(held[n])
        git(tmp_path, "add", "-A", ".")
        git(tmp_path, "commit", "-qm", str(k))
    raw = gitlog.raw_log(spark, [str(tmp_path)], 7).cache()
    today, want = {}, set()
    for pos, rows in groupby(sorted(raw.collect(), key=lambda r: r["pos"]), key=lambda r: r["pos"]):
        renamed = {}
        for r in rows:
            now = today.get(r["path"], r["path"])
            if r["before"]:
                renamed[r["before"]] = now
                today.pop(r["path"], None)
            want.add((pos, r["path"], now))
        today |= renamed
    assert raw.where("before is not null").count() > 5
    assert {(r["pos"], r["source_path"], r["path"]) for r in gitlog.todays_paths(raw).collect()} == want


def test_log_follows_renames(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "old.py").write_text("def f(x):\n    return x\n\n\ndef g(x):\n    return x\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    git(tmp_path, "mv", "old.py", "new\tname.py")
    git(tmp_path, "commit", "-qm", "two")
    (tmp_path / "old.py").write_text("x = 1\n")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "three")
    log = workspace.commit_log(spark, [str(tmp_path)]).cache()
    assert sorted((r["subject"], r["path"], r["source_path"]) for r in log.collect()) == [("one", "new\tname.py", "old.py"), ("three", "old.py", "old.py"), ("two", "new\tname.py", "new\tname.py")]
    assert {r["path"]: r["source"] for r in workspace.first_versions(log).collect()} == {"new\tname.py": "def f(x):\n    return x\n\n\ndef g(x):\n    return x\n", "old.py": "x = 1\n"}
    assert workspace.commit_log(spark, [str(tmp_path / "none")]).first()["error"]


def test_scan(spark, tmp_path):
    repo = tmp_path / "repo"
    for path, text in CODE.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    git(repo, "init", "-q")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "start")
    (repo / "src/a.py").write_text(CODE["src/a.py"].replace("return 2", "for y in x:\n        if y:\n            return y"))
    git(repo, "commit", "-qam", "fix")
    sources = workspace.read_sources(spark, str(repo)).cache()
    log = workspace.commit_log(spark, [str(repo)]).cache()
    got = scan.scan_files(sources, log, as_of=datetime.now(), versions=workspace.first_versions(log)).cache()
    rows = {r["path"]: r for r in got.collect()}
    assert set(rows) == set(CODE) and rows["src/broken.py"]["static_errors"] and rows["src/broken.py"]["lines_of_code"] is None and rows["src/broken.py"]["update_count"] == 1
    assert "Failed to parse file" in rows["src/broken.py"]["duplication_errors"][0] and rows["src/broken.py"]["duplicate_blocks_count"] == 0 and not rows["src/a.py"]["duplication_errors"]
    a = rows["src/a.py"]
    assert (a["update_count"], a["bug_fix_commit_count"], a["fan_out"], rows["src/pkg/b.py"]["fan_in"]) == (2, 1, 1, 1) and a["cyclomatic_complexity_growth_rate"] > 0 and 0 < a["refactor_score"] <= 1 and a["score_confidence"] == 1
    summary = scan.store_scan(got, 7, datetime(2026, 1, 1), str(tmp_path / "store")).first()
    scan.store_scan(got, 8, datetime(2026, 1, 1), str(tmp_path / "store"))
    scan.store_scan(got.where("path <> 'src/broken.py'"), 7, datetime(2026, 1, 2), str(tmp_path / "store"))
    assert summary["files_evaluated"] == 3
    folder = str(tmp_path / "store")
    kept = scan.scan_store(spark, folder).read("payloads").collect()
    assert sorted((r["scan_id"], r["path"]) for r in kept) == [(7, "src/a.py"), (7, "src/pkg/b.py"), *((8, p) for p in sorted(CODE))]
    records = spark.read.parquet(str(tmp_path / "store" / "records"))
    assert records.count() == 5 * 8
    bad = {(r["layer"]): (r["files"], r["files_with_errors"]) for r in scan.layer_failures(records.where("scan_id = 8")).collect()}
    assert bad["static"] == (3, 1) and bad["history"] == (3, 0)


def test_scan_with_failed_layers(spark):
    sources = spark.createDataFrame(list(CODE.items()), "path string, source string")

    def broken(_):
        raise ValueError("no provider")

    rows = {r["path"]: r for r in scan.scan_files(sources, None, embed=broken).collect()}
    for r in rows.values():
        assert r["update_count"] is None and "no repository" in r["history_errors"][0] and r["duplicate_blocks_count"] is None and "no provider" in r["duplication_errors"][0]
    assert rows["src/a.py"]["fan_out"] == 1 and rows["src/a.py"]["history_score"] is None and rows["src/a.py"]["score_confidence"] < 1 and rows["src/a.py"]["refactor_score"] is not None


def test_sinks_of_a_scan_change_together(spark, tmp_path):
    metrics = [m for names in scan.LAYERS.values() for m in names]
    scored = spark.createDataFrame([("a.py",), ("b.py",)], "path string").withColumns({m: F.lit(0.5) for m in metrics})
    scored = scored.withColumns({f"{n}_errors": scan.no_errors() for n in scan.LAYERS}).withColumn("priority_band", F.lit("low"))
    edges = spark.createDataFrame([("a.py", "b.py", True)], "src string, dst string, is_runtime boolean")
    folder, at = str(tmp_path / "store"), datetime(2026, 1, 1)
    scan.store_scan(scored, 1, at, folder, dependencies=edges)
    read = lambda name: [tuple(r) for r in scan.scan_store(spark, folder).read(name).orderBy("scan_id").collect()]
    before = read("payloads"), read("dependencies")
    assert [r[1] for r in sorted(before[0])] == ["a.py", "b.py"] and before[1] == [(1, "a.py", "b.py", True)]
    broken = edges.withColumn("dst", F.raise_error(F.lit("the sink breaks")).cast("string"))
    summary = scan.store_scan(scored.where("path = 'a.py'"), 1, at, folder, dependencies=broken).first()
    assert summary["files_evaluated"] == 1  # the scan goes on
    assert sorted(read("payloads")) == sorted(before[0]) and read("dependencies") == before[1]
    (tmp_path / "blocked").write_text("no folder")
    assert store.best_effort(store.append_records, edges, str(tmp_path / "blocked")) is False
    with pytest.raises(TypeError):
        store.best_effort(store.append_records, edges)
