"""Queries of what a scan stores, of keyed batches and of streams, on the analog tables, with SQL of the same result."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import duplication, graph, scoring
from ..sources import coverage, store, versions
from ..sources.storage import cut, shared_dir
from ..streaming import lifecycle
from . import files as fl
from . import scan as scan_plan
from . import snapshots as sn
from .analog import Tables
from .queries import DIRECTORY, METRICS, PERCENT, SCAN, metric_rows, query, score_sql

# Records of layers


@query("""SELECT scan_id, layer, count(*) AS files, count(*) FILTER (turn % 4 = 0) AS files_with_errors, count(*) FILTER (turn % 3 = 0) AS unknown_metrics FROM records GROUP BY scan_id, layer""")
def layer_failures(t: Tables) -> DataFrame:
    """Paths with errors and unknown metrics of each scan and layer."""
    rows = t.records.withColumn("metrics", F.expr("map('turn', case when turn % 3 <> 0 then cast(turn as double) end, 'always', 1D)")).withColumn("errors", F.expr("case when turn % 4 = 0 then array('e') else cast(array() as array<string>) end"))
    return scan_plan.layer_failures(rows)


def known_sql() -> str:
    parts = []
    for name, metrics in scan_plan.LAYERS.items():
        have = [m for m in metrics if m in METRICS or name == "decision"]
        counted = " + ".join(["0", *(f"CAST({m} IS NOT NULL AS INTEGER)" for m in have)])
        parts.append(f"SELECT l_partkey AS path, '{name}' AS layer, CAST({counted} AS BIGINT) AS known, {len(metrics)} AS metrics FROM metrics JOIN final USING (l_partkey)")
    return score_sql() + " UNION ALL ".join(parts)


@query(known_sql())
def layer_records(t: Tables) -> DataFrame:
    """The records that a scan appends, a row for each path and layer, with the number of metrics that are known."""
    scored = scoring.score_files(metric_rows(t)).withColumn("path", F.col("l_partkey"))
    wanted = {m for metrics in scan_plan.LAYERS.values() for m in metrics}
    scored = scored.withColumns({m: F.lit(None).cast("double") for m in sorted(wanted - set(scored.columns))}).withColumns({f"{n}_errors": scan_plan.no_errors() for n in scan_plan.LAYERS if n != "decision"})
    rows = scan_plan.layer_records(scored, SCAN, datetime(2026, 1, 1))
    known = F.size(F.map_filter("metrics", lambda _, v: v.isNotNull())).cast("long")
    return rows.select("path", "layer", known.alias("known"), F.size("metrics").alias("metrics"))


@query("""WITH made AS (SELECT l_orderkey, min(l_returnflag) AS layer, 'f' || CAST(l_orderkey AS VARCHAR) AS file_path, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey % 4 AS VARCHAR))), '|') AS nodes, array_to_string(list_sort(list(DISTINCT CAST(l_linenumber % 3 AS VARCHAR))), '|') AS edges FROM lineitem GROUP BY l_orderkey)
SELECT layer, min(file_path) AS file_path, nodes, edges FROM made GROUP BY layer, nodes, edges""")
def distinct_cycles(t: Tables) -> DataFrame:
    """Cycles with equal layer, nodes and edges once, by the first path."""
    rows = t.read("lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("layer"), F.collect_set((F.col("l_suppkey") % 4).cast("string")).alias("nodes"), F.collect_set((F.col("l_linenumber") % 3).cast("string")).alias("edges"))
    return sn.distinct_cycles(rows.select("layer", F.concat(F.lit("f"), "l_orderkey").alias("file_path"), "nodes", "edges"))


# Queue, reasons, samples

@query(f"""WITH changed AS (SELECT item_id, project_id, CASE WHEN item_id = {SCAN} THEN 'done' ELSE status END AS status, position, item_id = {SCAN} AS moved FROM items),
placed AS (SELECT *, CASE WHEN moved THEN 1.5 ELSE row_number() OVER (PARTITION BY project_id, status, moved ORDER BY position, item_id) - 1 END AS place FROM changed)
SELECT item_id, project_id, status, CAST(row_number() OVER (PARTITION BY project_id, status ORDER BY place, item_id) - 1 AS INTEGER) AS position FROM placed""")
def refactor_queue_move(t: Tables) -> DataFrame:
    """An item moved to another state and place, all others closing up."""
    return sn.queue_move(t.items, SCAN, "done", 2)


REASONS = "filter(array(case when file_id % 2 = 0 then 'long' end, concat('r', file_id % 5), case when file_id % 3 = 0 then 'copied' end), x -> x is not null)"


@query(f"""WITH rows AS (SELECT {DIRECTORY} AS path, file_path, file_id, priority_band, {PERCENT.format("refactor_score")} AS score FROM files),
said AS (SELECT path, file_path, unnest(list_filter([CASE WHEN file_id % 2 = 0 THEN 'long' END, 'r' || CAST(file_id % 5 AS VARCHAR), CASE WHEN file_id % 3 = 0 THEN 'copied' END], lambda x: x IS NOT NULL)) AS reason,
         generate_subscripts(list_filter([CASE WHEN file_id % 2 = 0 THEN 'long' END, 'r' || CAST(file_id % 5 AS VARCHAR), CASE WHEN file_id % 3 = 0 THEN 'copied' END], lambda x: x IS NOT NULL), 1) AS n FROM rows),
counted AS (SELECT path, reason, count(*) AS c, min((file_path, n)) AS first FROM said GROUP BY path, reason),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, first, reason) AS r FROM counted),
best AS (SELECT path, string_agg(reason, '|' ORDER BY r) AS top_risk_reasons FROM ranked WHERE r <= 3 GROUP BY path),
folders AS (SELECT path, count(*) FILTER (priority_band IN ('critical', 'high')) AS bad, round(avg(score), 2) AS mean FROM rows GROUP BY path)
SELECT path, top_risk_reasons FROM folders LEFT JOIN best USING (path) ORDER BY bad DESC, mean DESC, path LIMIT 5""")
def directory_reasons(t: Tables) -> DataFrame:
    """The most frequent reasons of the folders with most critical and high files."""
    return fl.directory_insight(t.files.withColumn("reasons", F.expr(REASONS)), reasons="reasons").select("path", "top_risk_reasons")


MATCHES = "SELECT DISTINCT l_suppkey AS path, CAST(l_partkey % 40 AS INTEGER) AS block, 'p' || CAST(l_partkey % 17 AS VARCHAR) AS peer, l_discount AS similarity FROM lineitem"


@query(f"""WITH matches AS ({MATCHES}), rows AS (SELECT path, block, max(similarity) AS similarity, list_sort(list(DISTINCT peer))[1:5] AS peers FROM matches GROUP BY path, block)
SELECT path, block, similarity, array_to_string(peers, '|') AS peers FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY block) AS n FROM rows) WHERE n <= 5""")
def match_samples(t: Tables) -> DataFrame:
    """Of each path's first matching blocks the first peers and the highest similarity."""
    return duplication.match_sample(t.read("lineitem").selectExpr("l_suppkey path", "cast(l_partkey % 40 as int) block", "concat('p', l_partkey % 17) peer", "l_discount similarity"))


@query("""WITH peers AS (SELECT file_id, scan_id, n, CASE n WHEN 0 THEN file_path WHEN 1 THEN 'none.py' ELSE 'src/m1/f' || CAST(file_id % 50 AS VARCHAR) || '.py' END AS file_path FROM files, (VALUES (0), (1), (2)) v(n)),
found AS (SELECT p.file_id, p.n, p.file_path, f.file_id AS peer_id FROM peers p LEFT JOIN (SELECT scan_id, file_path, file_id FROM files) f ON f.scan_id = p.scan_id AND f.file_path = p.file_path)
SELECT file_id, string_agg(file_path || '=' || coalesce(CAST(peer_id AS VARCHAR), '?'), '|' ORDER BY n, file_path, peer_id NULLS FIRST) AS matches FROM found GROUP BY file_id""")
def resolved_samples(t: Tables) -> DataFrame:
    """Paths of samples as references to files of the scan, unknown ones without an id."""
    files = t.files
    samples = files.select("file_id", "scan_id", F.expr("array(file_path, 'none.py', concat('src/m1/f', file_id % 50, '.py'))").alias("peers"))
    return fl.resolve_samples(samples, files).select("file_id", F.transform("matches", lambda m: F.concat(m["file_path"], F.lit("="), F.coalesce(m["peer_id"].cast("string"), F.lit("?")))).alias("matches"))


METADATA = """case file_id % 4 when 0 then concat('{"duplication_analysis": {"syntax_duplicate_blocks_sample": ["odd", {"kind": "function", "start_line": 3, "end_line": ', file_id % 90, ', "matched_files": ["', file_path, '", "none.py", "src/m1/f', file_id % 50, '.py"]}],
 "semantic_duplicate_blocks_sample": [{"kind": "class", "max_similarity": 0.5, "matched_files": []}, {"start_line": 7}]}}') when 1 then '{"duplication_analysis": "odd"}' when 2 then 'no json' end metadata"""


@query("""WITH held AS (SELECT * FROM files WHERE file_id % 4 = 0),
peers AS (SELECT file_id, scan_id, 0 AS n, file_path FROM held UNION ALL SELECT file_id, scan_id, 2, 'src/m1/f' || CAST(file_id % 50 AS VARCHAR) || '.py' FROM held),
found AS (SELECT p.file_id, string_agg(f.file_path || '=' || CAST(f.file_id AS VARCHAR), '|' ORDER BY n) AS matched FROM peers p JOIN files f USING (scan_id, file_path) GROUP BY p.file_id)
SELECT file_id, 'syntax' AS match_type, 1 AS place, 'function' AS kind, 3 AS start_line, CAST(file_id % 90 AS INTEGER) AS end_line, CAST(NULL AS DOUBLE) AS max_similarity, matched FROM held JOIN found USING (file_id)
UNION ALL SELECT file_id, 'semantic', 0, 'class', NULL, NULL, 0.5, '' FROM held UNION ALL SELECT file_id, 'semantic', 1, NULL, 7, NULL, NULL, '' FROM held""")
def duplicate_matches(t: Tables) -> DataFrame:
    """Matching blocks in the metadata of all files, their peers as references to files of the scan."""
    files = t.files
    rows = fl.duplicate_matches(files.selectExpr("file_id", "scan_id", METADATA), files)
    return rows.withColumn("matched", F.array_join(F.transform("matched_files", lambda m: F.concat(m["file_path"], F.lit("="), m["file_id"].cast("string"))), "|")).drop("matched_files")


@query("""WITH blocks AS (SELECT source AS path, doc_id, regexp_split_to_array(text, '\\s+') AS tokens FROM documents),
groups AS (SELECT tokens, count(DISTINCT path) AS n FROM blocks GROUP BY tokens)
SELECT path, count(*) AS duplicate_blocks_count, count(DISTINCT doc_id % 1000) AS duplicate_loc_count, max(n) AS duplication_group_size FROM blocks JOIN groups USING (tokens) WHERE n > 1 GROUP BY path""")
def syntax_duplicates(t: Tables) -> DataFrame:
    """Duplicate blocks, their lines and the largest group of each path, for blocks with equal tokens."""
    rows = t.read("documents").select(F.col("source").alias("path"), F.col("doc_id").alias("block"), F.array(F.col("doc_id") % 1000).alias("lines"), F.split("text", r"\s+").alias("tokens"))
    return duplication.syntax_metrics(rows, threshold=1.0)[0]


def shares_sql() -> str:
    """The shares of the score: what each component weighs among those that are known, and the bonus of the one that stands out."""
    names = list(scoring.COMPONENTS)
    excess = {n: f"coalesce({scoring.DOMINANCE[n]} * greatest(0.0, {n}_score - base_score), 0.0)" for n in names}
    dominant = "CASE " + " ".join(f"WHEN {excess[n]} >= greatest({', '.join(excess.values())}) THEN '{n}'" for n in names) + " END"
    available = " + ".join(f"CASE WHEN {n}_score IS NOT NULL THEN {w} ELSE 0.0 END" for n, w in scoring.COMPONENTS.items())
    rows = " UNION ALL ".join(f"SELECT l_partkey, '{n}' AS component, {k} AS ord, round(scale * ({w} * {n}_score / nullif(available, 0) + CASE WHEN dominant = '{n}' THEN bonus ELSE 0.0 END), 6) AS share FROM scaled" for k, (n, w) in enumerate(scoring.COMPONENTS.items()))
    return (
        score_sql()
        + f""", bonuses AS (SELECT *, {scoring.BONUS} * greatest({", ".join(excess.values())}) AS bonus, CAST({available} AS DOUBLE) AS available, {dominant} AS first FROM bases),
scaled AS (SELECT *, CASE WHEN bonus > 0 THEN first END AS dominant, CASE WHEN base_score + bonus > 1 THEN 1.0 / (base_score + bonus) ELSE 1.0 END AS scale FROM bonuses),
shares AS ({rows})
SELECT l_partkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY share DESC, ord) AS INTEGER) AS place, component, share FROM shares WHERE share > 0"""
    )


@query(shares_sql())
def score_contributions(t: Tables) -> DataFrame:
    """What each component adds to a score, the largest first."""
    scored = cut(scoring.score_files(metric_rows(t)).select("l_partkey", "contributions"))
    return scored.select("l_partkey", F.posexplode("contributions").alias("p", "c")).select("l_partkey", (F.col("p") + 1).alias("place"), "c.component", "c.share")


# The store

@query("SELECT customer, item, status FROM (SELECT o_custkey AS customer, o_orderkey AS item, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND status <> 'F'")
def latest_upserts(t: Tables) -> DataFrame:
    """The table that a log of upserts and deletes stands for."""
    log = t.read("orders").selectExpr("o_custkey customer", "o_orderkey item", "o_orderstatus status", "o_orderstatus = 'F' deleted")
    return store.latest_rows(log, ["customer"], "item")


@query("""WITH kept AS (SELECT scan_id FROM scans WHERE NOT EXISTS (SELECT 1 FROM projects p WHERE p.project_id = scans.project_id AND p.project_id % 4 = 0)),
rows AS (SELECT scan_id, count(*) AS files, count(refactor_score) AS scored FROM files GROUP BY scan_id),
edges AS (SELECT l_orderkey AS scan_id, count(*) AS edges FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) GROUP BY l_orderkey)
SELECT scan_id, files, CASE WHEN scan_id % 2 = 0 THEN 0 ELSE scored END AS scored, CASE WHEN scan_id % 2 = 0 THEN 0 ELSE edges END AS edges FROM rows JOIN kept USING (scan_id) JOIN edges USING (scan_id)""")
def committed_scans(t: Tables) -> DataFrame:
    """All scans stored, half of them replaced without scores and edges, a write that fails between two tables, and the scans of a quarter of the projects deleted in all tables: what readers see then."""
    spark = t.spark
    kept = versions.Store(spark, f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}", "scan_id", {"files": "file_id long, refactor_score double", "edges": "src long, dst long"})
    files = t.files.select("scan_id", "file_id", "refactor_score")
    edges = t.read("lineitem").selectExpr("l_orderkey scan_id", "l_partkey src", "l_suppkey dst").distinct()
    kept.replace({"files": files, "edges": edges})
    kept.replace({"files": files.where("scan_id % 2 = 0").withColumn("refactor_score", F.lit(None).cast("double"))})
    try:
        kept.replace({"files": files.limit(1000), "edges": edges.withColumn("dst", F.raise_error(F.lit("the writer dies")).cast("long"))})
    except PySparkException:
        pass  # its files are no version of anything
    gone = t.scans.join(t.projects.where("project_id % 4 = 0").select("project_id"), "project_id", "left_semi").select("scan_id")
    kept.delete(gone)
    found = kept.read("files").groupBy("scan_id").agg(F.count("*").alias("files"), F.count("refactor_score").alias("scored"))
    linked = kept.read("edges").groupBy("scan_id").agg(F.count("*").alias("edges"))
    return found.join(linked, "scan_id", "left").fillna(0, ["edges"])


@query("""WITH rows AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0),
batch AS (SELECT o_orderkey AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, o_custkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Customer#' || CAST(o_orderkey % 50 AS VARCHAR) WHEN o_orderkey % 7 = 1 THEN (SELECT min(c_name) FROM customer) ELSE 'new' || CAST(o_orderkey % 997 AS VARCHAR) END AS name FROM orders),
marked AS (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY ordinal) AS nth, r.id AS held, o.id AS owner, row_number() OVER (PARTITION BY b.name ORDER BY CAST(op = 'delete' AS INTEGER), ordinal) AS turn
           FROM batch b LEFT JOIN rows r ON r.id = b.id LEFT JOIN rows o ON o.name = b.name)
SELECT ordinal, op, id, name, coalesce(CASE WHEN nth > 1 THEN 'repeated' WHEN op = 'insert' AND held IS NOT NULL THEN 'exists' WHEN op <> 'insert' AND held IS NULL THEN 'missing' WHEN op <> 'delete' AND owner <> id THEN 'taken' WHEN op <> 'delete' AND turn > 1 THEN 'taken in batch' END, 'accepted') AS result FROM marked""")
def keyed_batch(t: Tables) -> DataFrame:
    """A batch of inserts, updates and deletes against a table with a key and unique names: what is accepted, and why the rest is not."""
    rows = t.read("customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey id", "c_name name")
    first = t.read("customer").agg(F.min("c_name").alias("first"))
    name = "case when o_orderkey % 7 = 0 then concat('Customer#', o_orderkey % 50) when o_orderkey % 7 = 1 then first else concat('new', o_orderkey % 997) end name"
    batch = t.read("orders").crossJoin(first).selectExpr("o_orderkey ordinal", "case o_orderkey % 3 when 0 then 'insert' when 1 then 'update' else 'delete' end op", "o_custkey id", name)  # one row of first
    return versions.judge(batch, rows, "id", [["name"]]).select("ordinal", "op", "id", "name", F.coalesce("reason", F.lit("accepted")).alias("result"))


# Imports and coverage by longest prefixes


@query("""WITH named AS (SELECT DISTINCT 'pkg.b' || CAST(p_partkey % 30 AS VARCHAR) AS module FROM part WHERE p_partkey % 30 < 20
  UNION SELECT DISTINCT 'pkg.b' || CAST(p_partkey % 30 AS VARCHAR) || '.m' || CAST(p_partkey % 11 AS VARCHAR) FROM part WHERE p_partkey % 4 = 0 UNION SELECT 'pkg'),
lines AS (SELECT 'pkg.b' || CAST(l_suppkey % 30 AS VARCHAR) AS path, l_orderkey * 8 + l_linenumber AS statement, CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'pkg' END || '.b' || CAST(l_partkey % 30 AS VARCHAR) AS base, 'm' || CAST(l_suppkey % 13 AS VARCHAR) AS name, l_returnflag <> 'R' AS is_runtime FROM lineitem),
tried AS (SELECT path, statement, 0 AS ordinal, base || '.' || name AS candidate, is_runtime FROM lines UNION ALL SELECT path, statement, 1, base, is_runtime FROM lines),
found AS (SELECT candidate, arg_max(module, length(module)) AS module FROM (SELECT DISTINCT candidate FROM tried) JOIN named ON starts_with(candidate || '.', module || '.') GROUP BY candidate),
first AS (SELECT path, statement, arg_min(module, ordinal) AS module, bool_or(is_runtime) AS is_runtime FROM tried JOIN found USING (candidate) GROUP BY path, statement)
SELECT path AS src, module AS dst, bool_or(is_runtime) AS is_runtime FROM first WHERE path <> module GROUP BY path, module""")
def import_resolution(t: Tables) -> DataFrame:
    """Edges of `from base import name`: a module base.name before the base itself, each by its longest known prefix."""
    whole = t.read("part").where("p_partkey % 30 < 20").selectExpr("concat('pkg.b', p_partkey % 30) module")
    inner = t.read("part").where("p_partkey % 4 = 0").selectExpr("concat('pkg.b', p_partkey % 30, '.m', p_partkey % 11) module")
    named = whole.union(inner).union(t.read("region").selectExpr("'pkg' module")).distinct().withColumn("path", F.col("module"))
    lines = t.read("lineitem").selectExpr(
        "concat('pkg.b', l_suppkey % 30) path", "l_orderkey * 8 + l_linenumber statement", "concat(if(l_partkey % 5 = 0, 'other', 'pkg'), '.b', l_partkey % 30) base", "concat('m', l_suppkey % 13) name", "l_returnflag <> 'R' is_runtime"
    )
    tried = lines.select("path", "statement", F.posexplode(F.array(F.concat_ws(".", "base", "name"), "base")).alias("ordinal", "candidate"), "is_runtime")
    return graph.resolve_imports(tried, named)


@query("""WITH subs AS (SELECT DISTINCT 'd' || CAST(s_suppkey % 7 AS VARCHAR) || '/e' || CAST(s_suppkey % 5 AS VARCHAR) AS folder FROM supplier WHERE s_suppkey % 3 = 0),
tops AS (SELECT DISTINCT 'd' || CAST(s_suppkey % 7 AS VARCHAR) AS folder, s_suppkey % 7 = 3 AS broken FROM supplier WHERE s_suppkey % 7 < 5),
code AS (SELECT l_partkey AS k, 'd' || CAST(l_partkey % 7 AS VARCHAR) AS top, 'd' || CAST(l_partkey % 7 AS VARCHAR) || '/e' || CAST(l_partkey % 5 AS VARCHAR) AS sub, l_linenumber, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY ALL),
ran AS (SELECT k, sub, CASE WHEN s.folder IS NOT NULL THEN r AND k % 4 <> 0 ELSE a END AS ran FROM code LEFT JOIN subs s ON sub = s.folder LEFT JOIN tops t ON top = t.folder WHERE s.folder IS NOT NULL OR NOT t.broken)
SELECT sub || '/f' || CAST(k AS VARCHAR) || '.py' AS path, CAST(count(*) AS INTEGER) AS n_statements, CAST(count(*) FILTER (NOT ran) AS INTEGER) AS n_missing FROM ran GROUP BY sub, k""")
def coverage_by_nearest_folder(t: Tables) -> DataFrame:
    """Statements that ran, of each source by the data file in the nearest folder above it; one that cannot be read covers nothing."""
    sub, top = "concat('d', l_partkey % 7, '/e', l_partkey % 5)", "concat('d', l_partkey % 7)"
    lines = t.read("lineitem").selectExpr("l_partkey k", f"concat({sub}, '/f', l_partkey, '.py') path", f"{sub} sub", f"{top} top", "cast(l_linenumber as int) line", "l_returnflag flag")
    code = lines.groupBy("path").agg(F.collect_set("line").alias("statements"))
    none = ["cast(null as string) path", "cast(null as array<int>) lines"]
    subs = t.read("supplier").where("s_suppkey % 3 = 0").selectExpr("concat('d', s_suppkey % 7, '/e', s_suppkey % 5) folder", *none, "cast(null as string) error")
    tops = t.read("supplier").where("s_suppkey % 7 < 5").selectExpr("concat('d', s_suppkey % 7) folder", *none, "if(s_suppkey % 7 = 3, 'Failed to read coverage', null) error")
    files = subs.union(tops).distinct()
    ran = lines.where("flag = 'R' and k % 4 <> 0").select(F.col("sub").alias("folder"), "path", "line").union(lines.where("flag = 'A'").select(F.col("top").alias("folder"), "path", "line"))
    rows = ran.groupBy("folder", "path").agg(F.collect_set("line").alias("lines")).join(files.select("folder").distinct(), "folder", "left_semi")
    return coverage.measured(code, files.unionByName(rows.withColumn("error", F.lit(None).cast("string"))))


# Streams

LIMIT = 21_600
STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@query(f"""WITH moves AS (SELECT user_id * 100 + day(ts) AS scan_id, {STATUS} AS asked, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id * 100 + day(ts) ORDER BY epoch_us(ts), {STATUS}) AS n FROM events),
folded AS (WITH RECURSIVE fold(scan_id, n, status, last, accepted, refused, timed_out) AS (
  SELECT DISTINCT scan_id, 0::BIGINT, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), 0, 0, 0 FROM moves
  UNION ALL
  SELECT scan_id, n, CASE WHEN ok THEN asked ELSE now END, CASE WHEN ok THEN us ELSE last END, accepted + CAST(ok AS INTEGER) + CAST(late AS INTEGER), refused + CAST(NOT ok AS INTEGER), timed_out + CAST(late AS INTEGER)
  FROM (SELECT *, coalesce(CASE asked WHEN 'pending' THEN now IS NULL WHEN 'running' THEN now = 'pending' WHEN 'succeeded' THEN now = 'running' ELSE now IN ('pending', 'running') END, false) AS ok
        FROM (SELECT f.scan_id, m.n, m.asked, m.us, f.last, f.accepted, f.refused, f.timed_out, coalesce(f.status IN ('pending', 'running') AND m.us > f.last + {LIMIT}000000, false) AS late,
                     CASE WHEN f.status IN ('pending', 'running') AND m.us > f.last + {LIMIT}000000 THEN 'failed' ELSE f.status END AS now
              FROM fold f JOIN moves m ON m.scan_id = f.scan_id AND m.n = f.n + 1))) SELECT * FROM fold),
ends AS (SELECT *, status IN ('pending', 'running') AND last + {LIMIT}000000 < (SELECT max(us) FROM moves) - 86400000000 AS due FROM folded QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC) = 1)
SELECT scan_id, CASE WHEN due THEN 'failed' ELSE status END AS status, CAST(accepted + CAST(coalesce(due, false) AS INTEGER) AS BIGINT) AS accepted, CAST(refused AS BIGINT) AS refused FROM ends""")
def scan_life_cycle(t: Tables) -> DataFrame:
    """A stream of transitions over the events, with a timer for scans that never end: the last state of each scan."""
    source = lifecycle.file_stream(t.spark, t.sf_dir, "events.parquet")
    changes = source.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("scan_id"), F.expr(STATUS).alias("status"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("error_message"))
    made = lifecycle.drained(lifecycle.transitions(changes, limit=LIMIT, late="1 day"))
    return lifecycle.last_states(made).select("scan_id", "status", "accepted", "refused")
