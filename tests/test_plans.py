import json
import math
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strataline.plans import files, projects, scans, snapshots

SCANS = "scan_id int, project_id int, status string, created_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp, error_message string"


def at(day, second=0):
    return datetime(2026, 7, day, 0, 0, 0) if not second else datetime(2026, 7, day, 0, second // 60, second % 60)


def test_timeline_and_states(spark):
    rows = spark.createDataFrame([(1, 1, "succeeded", at(11), None, None, at(11), None), (2, 1, "failed", at(12), None, None, at(12), "x")], SCANS)
    days = [r["count"] for r in scans.timeline_days(rows, "created_at", date(2026, 7, 13)).orderBy("date").collect()]
    assert len(days) == 14 and (days[-2], days[-3], days[0]) == (1, 1, 0)
    assert {r["status"]: r["count"] for r in scans.status_distribution(rows).collect()} == {"pending": 0, "running": 0, "succeeded": 1, "failed": 1, "cancelled": 0}


def test_admin_projects(spark):
    users = spark.createDataFrame([(1, "Alpha", "a@x"), (2, "zulu", "z@x")], "id int, username string, email string")
    rows = spark.createDataFrame([(1, 1, "Frequent", at(1)), (2, 1, "Slow", at(2)), (3, 2, "Empty", at(3))], "project_id int, user_id int, name string, created_at timestamp")
    done = spark.createDataFrame([(1, 1, "succeeded", at(4), at(4), at(4, 60), at(4), None), (2, 1, "succeeded", at(4), at(4), at(4, 120), at(4), None), (3, 2, "succeeded", at(4), at(4), at(4, 300), at(4), None)], SCANS)
    got = projects.admin_projects(rows, users, done, sort="scan_duration").collect()
    assert [(r["name"], r["average_scan_duration_seconds"]) for r in got] == [("Slow", 300.0), ("Frequent", 90.0), ("Empty", None)] and got[0]["total_count"] == 3
    assert projects.admin_projects(rows, users, done, sort="scan_count").first()["scan_count"] == 2
    assert [r["username"] for r in projects.admin_projects(rows, users, done, sort="owner", descending=False).collect()] == ["Alpha", "Alpha", "zulu"]


def test_project_state(spark):
    rows = spark.createDataFrame([(1, 9, "a", at(1)), (2, 9, "b", at(1)), (3, 9, "c", at(1))], "project_id int, user_id int, name string, created_at timestamp")
    done = spark.createDataFrame([(1, 1, "running", at(1), None, None, at(1), None), (2, 1, "failed", at(2), None, None, at(2), "e"), (3, 2, "succeeded", at(1), None, None, at(1), None), (4, 2, "failed", at(2), None, None, at(2), "e")], SCANS)
    assert {r["project_id"]: r["status"] for r in projects.user_projects(rows, done, 9).collect()} == {1: "running", 2: "failed", 3: None}


def test_transitions(spark):
    rows = spark.createDataFrame([(1, 1, "pending", at(1), None, None, at(1), "old"), (2, 1, "succeeded", at(1), at(1), at(1), at(1), None)], SCANS)
    go = spark.createDataFrame([(1, "running", at(2), "no"), (2, "running", at(2), None)], "scan_id int, status string, at timestamp, error_message string")
    got = {r["scan_id"]: r for r in scans.apply_status(rows, go).collect()}
    assert got[1]["status"] == "running" and got[1]["started_at"] == at(2) and got[1]["error_message"] is None and got[2]["status"] == "succeeded"


def test_kpis(spark):
    days = [datetime(2026, 6, 20)] * 3 + [datetime(2026, 5, 20)] * 2
    rows = spark.createDataFrame([(d,) for d in days], "created_at timestamp")
    got = projects.kpis({"users": (rows, "created_at"), "none": (rows.limit(0), "created_at")}, datetime(2026, 7, 13, 12)).collect()
    by = {r["entity"]: r for r in got}
    assert (by["users"]["current_period_count"], by["users"]["previous_period_count"], by["users"]["delta"], by["users"]["delta_percent"]) == (3, 2, 1, 50.0) and by["none"]["delta_percent"] is None


def test_queue(spark):
    rows = spark.createDataFrame([(k, 1, "todo", k) for k in range(4)], "item_id int, project_id int, status string, position int")
    got = {r["item_id"]: (r["status"], r["position"]) for r in snapshots.queue_move(rows, 3, "todo", 1).collect()}
    assert got == {0: ("todo", 0), 3: ("todo", 1), 1: ("todo", 2), 2: ("todo", 3)}
    got = {r["item_id"]: (r["status"], r["position"]) for r in snapshots.queue_move(rows, 1, "done", 9).collect()}
    assert got == {0: ("todo", 0), 2: ("todo", 1), 3: ("todo", 2), 1: ("done", 0)}


def test_distinct_cycles(spark):
    rows = spark.createDataFrame([("architecture", "b", ["x", "y"], ["xy"]), ("architecture", "a", ["y", "x"], ["xy"]), ("static", "a", ["x", "y"], ["xy"])], "layer string, file_path string, nodes array<string>, edges array<string>")
    assert sorted((r["layer"], r["file_path"]) for r in snapshots.distinct_cycles(rows).collect()) == [("architecture", "a"), ("static", "a")]


def test_page_counts():
    assert scans.page_counts(21, 2, 10) == {"total_pages": 3, "has_next": True, "has_prev": True}


@pytest.mark.parametrize("name", ["refactor_scores", "top_files", "file_languages", "owned_scan_files", "priority_labels", "graph_degrees", "history_metrics", "semantic_matches", "snapshot"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    from strataline.plans import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.sql(queries.ORACLE[name])
    assert got == sorted((tuple(norm(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


def test_streaming_windows(spark, tmp_path):
    from strataline.streaming.events import windowed_counts

    rows = spark.createDataFrame([(datetime(2024, 1, 1, 3), "a", 1.0), (datetime(2024, 1, 1, 4), "a", 2.0), (datetime(2024, 1, 5), "b", 1.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.sql("select * from windows").collect()] == [("a", 2, 3.0)]
    assert windowed_counts(rows).agg(F.sum("n")).first()[0] == 3


def test_whole_tables(spark, tmp_path):
    """Queries of whole tables against brute force."""
    from strataline.plans import queries

    lines = [(o, p, s, n, "NAR"[(o + p) % 3], (o + p) % 10 / 100, datetime(2020, 1, 1 + n)) for o in (1, 7, 51, 100) for n, (p, s) in enumerate([(3 * o, 2), (o + 5, 9), (o + 10, 13), (2, o + 10), (3 * o, 4), (62, 12)], 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_discount double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(o, 3 + 20 * (o % 3), "FOP"[o % 3]) for o in range(1, 34)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 40)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())

    path = lambda p: ("" if p % 11 == 0 else f"src/m{p % 7}/") + f"f{p}" + (".JS" if p % 5 == 0 else ".py")
    files = {(o, o * 1000000 + p): path(p) for o, p, *_ in lines}
    pairs = sorted((o, a, b, files[o, a], files[o, b]) for o, a in files for q, b in files if o == q and a != b and a % 3 == 0 and b % 4 == 1)
    assert pairs and got("dependency_graph") == pairs
    groups: dict = {}
    for (o, f), name in files.items():
        groups.setdefault((o, f % 3), []).append(name)
    assert got("circular_dependencies") == sorted((*k, len(v), "|".join(sorted(v))) for k, v in groups.items())
    most = Counter(a for _, a, *_ in pairs)
    one = min(a for a in most if most[a] == max(most.values()))
    touching = {(b if a == one else a, "outgoing" if a == one else "incoming") for _, a, b, *_ in pairs if one in (a, b)}
    assert touching and {r[:2] for r in got("file_dependencies")} == touching and {r[0] for r in got("co_changed_files")} == {f for f, _ in touching}
    layers: dict = {}
    for o, p, _, _, flag, *_ in lines:
        layers.setdefault((o, p % 50), set()).add(flag)
    assert got("file_payloads") == sorted((*k, "|".join(sorted(v)), len(v)) for k, v in layers.items())
    named = {(o, p % 50) for o, p, *_ in lines}
    assert got("stored_dependency_edges") == sorted({(o, o * 100 + p % 50, o * 100 + s % 50) for o, p, s, *_ in lines if (o, s % 50) in named and p % 50 != s % 50})
    assert got("import_prefixes") == sorted({(s, f"a.b{p % 30}.c", f"a.b{p % 30}" if p % 30 < 20 else "a") for _, p, s, *_ in lines})
    state = {"F": "done", "O": "in_progress", "P": "todo"}
    items = [(o, c % 20, state[x], o % 13) for o, c, x in orders]
    want = [(o, p, st, sum((q, x, b, a) < (p, st, pos, o) and (q, x) == (p, st) for a, q, x, b in items)) for o, p, st, pos in items]
    assert got("refactor_queue_positions") == sorted(want) and got("refactor_queue_next") == [(max(i[3] for i in items if i[2] == "todo") + 1,)]


def test_directory_insight(spark, tmp_path):
    from strataline.plans import files as fl
    from strataline.plans import queries

    lines = [(o, p, "NAR"[(o + p) % 3], (o * p) % 11 / 100, datetime(2020, 1, 1)) for o in (1, 7, 51, 100) for p in range(1, 60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_discount double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    groups: dict = {}
    for o, p, flag, discount, _ in lines:
        known = flag != "N"
        score = round(discount * 10, 5) if known else 0.0
        where = "(root)" if p % 11 == 0 else f"src/m{p % 7}"
        name = ("" if p % 11 == 0 else f"{where}/") + f"f{p}" + (".JS" if p % 5 == 0 else ".py")
        groups.setdefault(where, []).append((-round(score * 100, 2), name, known and score >= 0.7, known and 0.55 <= score < 0.7))
    want = []
    for where, g in groups.items():
        want.append((where, sum(x[2] for x in g), sum(x[3] for x in g), math.floor(-sum(x[0] for x in g) / len(g) * 100 + 0.5) / 100, "|".join(x[1] for x in sorted(g)[:3])))
    want.sort(key=lambda r: (-r[1] - r[2], -r[3], r[0]))
    assert [tuple(r) for r in queries.QUERIES["directory_insight"](spark, str(tmp_path)).collect()] == want[:5]
    some = spark.range(9).selectExpr("id file_id", "concat('a/f', id) file_path", "0.1D refactor_score", "'low' priority_band")
    plan = fl.directory_insight(some)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_whole_graphs(spark, tmp_path):
    """Graphs of all lines against brute force."""
    import random
    from collections import deque

    from strataline.operators import graph
    from strataline.plans import queries

    rng = random.Random(4)
    lines = sorted({(rng.randint(1, 40), rng.randint(90, 112), rng.randint(90, 112), rng.randint(1, 6)) for _ in range(60)})
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    nodes = sorted({x for _, p, s, _ in lines for x in (p, s)})
    live, every = {(p, s) for _, p, s, n in lines if n % 3 and p != s}, {(p, s) for _, p, s, _ in lines if p != s}
    after = {v: sorted(b for a, b in live if a == v) for v in nodes}
    reach, total = set(), dict.fromkeys(nodes, 0.0)
    for s in nodes:  # by Brandes
        depth, count, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            order.append(v := queue.popleft())
            for w in after[v]:
                reach.add((s, w))
                if w not in depth:
                    depth[w], count[w] = depth[v] + 1, 0.0
                    queue.append(w)
                count[w] += count[v] * (depth[w] == depth[v] + 1)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in (v for v in order if w in after[v] and depth[w] == depth[v] + 1):
                share[v] += count[v] / count[w] * (1 + share[w])
            total[w] += share[w] * (w != s)
    assert got("graph_type_only_edges") == sorted(every - live) and got("graph_closure") == sorted(reach)
    assert [r[:3] for r in got("graph_degrees")] == [(v, sum(b == v for _, b in live), len(after[v])) for v in nodes]
    assert got("graph_dependents") == [(v, sum(b == v != a for a, b in reach)) for v in nodes]
    mutual = {v: [w for w in nodes if w != v and (v, w) in reach and (w, v) in reach] for v in nodes}
    assert any(mutual.values()) and got("graph_cycles") == [(v, min(m + [v]) if m else None, len(m) + 1 if m else 0) for v, m in mutual.items()]
    want, scale = {str(v): total[v] for v in nodes}, (len(nodes) - 1) * (len(nodes) - 2)
    near = lambda rows: {r["node"] for r in rows} == set(want) and all(abs(r["betweenness_centrality"] - want[r["node"]] / scale) < 2e-6 for r in rows)
    assert max(want.values()) > 0 and near(queries.QUERIES["graph_betweenness"](spark, str(tmp_path)).collect())
    one, links = spark.createDataFrame([(v,) for v in nodes], "node long"), spark.createDataFrame(sorted(live), "src long, dst long")
    both = [d.selectExpr("*", "explode(array('a', 'b')) g") for d in (one, links)]
    rows = graph.betweenness(*both, graph="g", block=20).collect()  # in three blocks
    assert near([r for r in rows if r["g"] == "a"]) and near([r for r in rows if r["g"] == "b"]) and len(rows) == 2 * len(nodes)
    assert {r["betweenness_centrality"] for r in graph.betweenness(one, links.limit(0)).collect()} == {0.0}


def test_file_report(spark):
    done = spark.createDataFrame([(1, 1, "succeeded", at(1), at(1), at(2), at(2), None)], SCANS)
    own = spark.createDataFrame([(1, 9, "a", at(1))], "project_id int, user_id int, name string, created_at timestamp")
    block = lambda *peers, **more: {"kind": "function", "matched_files": list(peers)} | more
    metadata = {"duplication_analysis": {"syntax_duplicate_blocks_sample": [block("c.py", "gone.py", "b.py", start_line=2, end_line=9), 5, None, [1], block("b.py", "b.py")], "semantic_duplicate_blocks_sample": [block(max_similarity=0.9), {"kind": "class", "matched_files": None}]}}
    rows = [(k, 1, f"{n}.py", 0.5, "high", at(1), json.dumps(metadata) if n == "a" else None) for k, n in enumerate("abcd")] + [(8, 2, "b.py", 0.1, "low", at(1), "[1]"), (9, 2, "x.py", 0.1, "low", at(1), '{"duplication_analysis": {"syntax_duplicate_blocks_sample": "text"}}')]
    table = spark.createDataFrame(rows, "file_id int, scan_id int, file_path string, refactor_score double, priority_band string, created_at timestamp, metadata string")
    edges = spark.createDataFrame([(0, 2), (0, 1), (1, 0), (3, 0), (2, 3)], "source_file_id int, target_file_id int")
    members = spark.createDataFrame([(1, 7, 0), (1, 7, 1), (1, 8, 3), (2, 7, 9)], "scan_id int, group_id int, file_id int")
    together = spark.createDataFrame([(0, 3), (1, 2)], "file_id_a int, file_id_b int")
    (got,) = files.file_report(done, own, table, edges, members, together, 0, 9).collect()
    names = lambda c: [x["file_path"] for x in got[c]]
    assert (names("depends_on"), names("dependents"), names("cycle"), names("changed_with")) == (["b.py", "c.py"], ["b.py", "d.py"], ["b.py"], ["d.py"]) and got["last_scan_at"] == at(2) and got["language"] == "Python"
    matches = [(m["match_type"], m["kind"], m["start_line"], m["max_similarity"], [(f["file_id"], f["file_path"]) for f in m["matched_files"]]) for m in got["duplicate_matches"]]
    assert matches == [("syntax", "function", 2, None, [(2, "c.py"), (1, "b.py")]), ("syntax", "function", None, None, [(1, "b.py"), (1, "b.py")]), ("semantic", "function", None, 0.9, []), ("semantic", "class", None, None, [])]
    (alone,) = files.file_report(done, own, table, edges.limit(0), members.limit(0), together.limit(0), 1, 9).collect()
    assert alone["duplicate_matches"] == alone["cycle"] == alone["depends_on"] == []
    assert files.file_report(done, own, table, edges, members, together, 9, 9).isEmpty() and files.file_report(done, own, table, edges, members, together, 0, 1).isEmpty()
    assert files.duplicate_matches(table.where("scan_id = 2"), table).isEmpty()
