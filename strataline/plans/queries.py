"""Every engine operation on the analog tables, with SQL of the same result."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons, paths
from ..functions.numeric import percent
from ..operators import duplication, graph, history, scoring
from ..sources import store
from . import files as fl
from . import projects as pr
from . import scans as sc
from . import snapshots as sn
from .analog import SQL, Tables, plain

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PROJECT, SCAN, USER = 58, 56, 5
AS_OF = date(1998, 6, 15)
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def query(sql: str | None = None):
    """Register a query of tables, and its SQL, which may use the analog tables."""

    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Tables(spark, sf_dir)))
        QUERIES[name].__doc__ = fn.__doc__
        if sql:
            text = sql.strip()
            ORACLE[name] = f"{SQL.rstrip()},\n{text[5:]}" if text.startswith("WITH ") else SQL + text
        return fn

    return add


def times(*names: str) -> str:
    return ", ".join(TS.format(n) for n in names)


@query(f"""WITH own AS (SELECT s.* FROM scans s JOIN projects p USING (project_id) WHERE user_id = {USER})
SELECT scan_id, project_id, status, {times("started_at", "finished_at", "created_at", "updated_at")}, total_count FROM
(SELECT *, (SELECT count(*) FROM own) AS total_count FROM own ORDER BY own.created_at DESC, scan_id DESC LIMIT 10 OFFSET 10)""")
def list_scans(t: Tables) -> DataFrame:
    return sc.list_scans(t.scans, t.projects, USER, number=2, limit=10)


@query(f"""WITH own AS (SELECT s.*, p.name AS project_name, u.id AS user_id, username, email FROM scans s JOIN projects p USING (project_id) JOIN users u ON u.id = p.user_id WHERE status = 'succeeded')
SELECT scan_id, status, error_message, {times("created_at", "started_at", "finished_at")}, project_id, project_name, user_id, username, email, total_count FROM
(SELECT *, (SELECT count(*) FROM own) AS total_count FROM own ORDER BY own.created_at, scan_id DESC LIMIT 20)""")
def list_admin_scans(t: Tables) -> DataFrame:
    return sc.list_admin_scans(t.scans, t.projects, t.users, status="succeeded", limit=20, descending=False)


@query("""WITH own AS (SELECT s.*, p.name AS project_name, u.id AS user_id, username, coalesce(finished_at, updated_at, s.created_at) AS ended FROM scans s JOIN projects p USING (project_id) JOIN users u ON u.id = p.user_id WHERE status = 'failed')
SELECT scan_id, error_message, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended_at, project_id, project_name, user_id, username FROM own ORDER BY ended DESC, scan_id DESC LIMIT 10""")
def failed_scans(t: Tables) -> DataFrame:
    return sc.failed_scans(t.scans, t.projects, t.users)


@query("""WITH days AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1998-06-02', DATE '1998-06-15', INTERVAL 1 DAY) g(d))
SELECT CAST(days.date AS VARCHAR) AS date, count(scan_id) AS count FROM days LEFT JOIN scans ON CAST(created_at AS DATE) = days.date GROUP BY days.date""")
def scans_over_time(t: Tables) -> DataFrame:
    return sc.timeline_days(t.scans, "created_at", AS_OF)


@query("SELECT s.status, count(scan_id) AS count FROM (VALUES ('pending'), ('running'), ('succeeded'), ('failed'), ('cancelled')) s(status) LEFT JOIN scans USING (status) GROUP BY s.status")
def status_distribution(t: Tables) -> DataFrame:
    return sc.status_distribution(t.scans)


@query(f"""SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running
FROM scans JOIN projects USING (project_id) WHERE user_id = {USER}""")
def status_counts(t: Tables) -> DataFrame:
    return sc.status_counts(t.scans, t.projects, USER)


LAST = f"WITH last AS (SELECT * FROM scans WHERE project_id = {PROJECT} AND status = 'succeeded' AND finished_at IS NOT NULL ORDER BY finished_at DESC, scan_id DESC LIMIT 20)\n"
PERCENT = "round(greatest(0, least(1, coalesce({0}, 0))) * 100, 2)"


@query(LAST + f"SELECT l.scan_id, strftime(l.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, {PERCENT.format('avg(refactor_score)')} AS average_score FROM last l LEFT JOIN files f USING (scan_id) GROUP BY l.scan_id, l.finished_at")
def project_risk_trend(t: Tables) -> DataFrame:
    return sc.risk_trend(t.scans, t.projects, t.files, PROJECT)


@query(f"""WITH last AS (SELECT * FROM scans WHERE project_id = {PROJECT} AND status IN ('succeeded', 'failed') AND finished_at IS NOT NULL AND started_at IS NOT NULL ORDER BY finished_at DESC, scan_id DESC LIMIT 20)
SELECT scan_id, status, {times("finished_at")}, round(greatest(0.0, (epoch_us(last.finished_at) - epoch_us(started_at)) / 1e6), 2) AS duration_seconds FROM last""")
def duration_trend(t: Tables) -> DataFrame:
    return sc.duration_trend(t.scans, t.projects, PROJECT)


BANDS = ", ".join(f"count(*) FILTER (priority_band = '{b}') AS {b}" for b in ("critical", "high", "medium", "low"))


@query(LAST + f"SELECT l.scan_id, strftime(l.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, {BANDS} FROM last l LEFT JOIN files f USING (scan_id) GROUP BY l.scan_id, l.finished_at")
def priority_distribution(t: Tables) -> DataFrame:
    return fl.priority_distribution(t.scans, t.projects, t.files, PROJECT)


@query(LAST + "SELECT l.scan_id, strftime(l.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, count(file_id) AS files_analyzed FROM last l LEFT JOIN files f USING (scan_id) GROUP BY l.scan_id, l.finished_at")
def files_analyzed_trend(t: Tables) -> DataFrame:
    return fl.files_analysed(t.scans, t.projects, t.files, PROJECT)


@query(f"SELECT file_id, file_path, priority_band FROM files JOIN scans USING (scan_id) WHERE scan_id = {SCAN} AND status = 'succeeded'")
def list_scan_files(t: Tables) -> DataFrame:
    return fl.list_scan_files(t.scans, t.projects, t.files, SCAN, None)


OWN_SCAN = f"(SELECT max(scan_id) FROM scans JOIN projects USING (project_id) WHERE status = 'succeeded' AND user_id = {USER})"


@query(f"SELECT file_id, file_path, priority_band FROM files JOIN scans USING (scan_id) JOIN projects USING (project_id) WHERE scan_id = {OWN_SCAN} AND user_id = {USER}")
def owned_scan_files(t: Tables) -> DataFrame:
    """Files of a user's newest scan; another user's request for it gives none."""
    own = t.scans.where("status = 'succeeded'").join(t.projects.where(F.col("user_id") == USER).select("project_id"), "project_id", "left_semi")
    scan = own.agg(F.max("scan_id")).first()[0]
    found = fl.list_scan_files(t.scans, t.projects, t.files, scan, USER)
    return found.unionByName(fl.list_scan_files(t.scans, t.projects, t.files, scan, USER + 1))


@query("SELECT DISTINCT CASE priority_band WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Unscored' END AS label, priority_band FROM files")
def priority_labels(t: Tables) -> DataFrame:
    return t.files.select(F.coalesce(F.initcap("priority_band"), F.lit("Unscored")).alias("label"), "priority_band").distinct()


SUFFIXES = [*paths.LANGUAGES, ".xyz", ""]
KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in paths.LANGUAGES.items())
PLACED = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SUFFIXES))


@query(f"""WITH suffixes(k, s) AS (VALUES {PLACED}),
named AS (SELECT p_partkey, 'src/a.b/f' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN upper(s) ELSE s END AS path, s FROM part JOIN suffixes ON p_partkey % {len(SUFFIXES)} = k)
SELECT path, coalesce(language, 'Unknown') AS language FROM named LEFT JOIN (VALUES {KNOWN}) l(suffix, language) ON s = suffix""")
def file_languages(t: Tables) -> DataFrame:
    """The language of paths of all suffixes, in both cases."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("src/a.b/f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.upper(suffix)).otherwise(suffix))
    return t.read("part").select(path.alias("path")).select("path", paths.language(F.col("path")).alias("language"))


REPLY = "CASE WHEN turn % 5 = 4 THEN 'no object ' || role ELSE 'Here: ```json' || chr(10) || '{{\"role\": \"' || role || '\", \"turn\": ' || CAST(turn AS VARCHAR) || CASE WHEN turn % 5 = 3 THEN '' ELSE '}}' END || chr(10) || '``` {end}' END"


@query(f"""WITH texts AS (SELECT conv_id, turn, {REPLY.format(end="end.")} AS text FROM conversations), found AS (SELECT conv_id, turn, nullif(regexp_extract(text, '\\{{.*\\}}', 0, 's'), '') AS object FROM texts)
SELECT conv_id, turn, object, CASE WHEN object IS NULL THEN NULL ELSE json_extract_string(object, '$.role') END AS role FROM found""")
def salvaged_json(t: Tables) -> DataFrame:
    """JSON objects out of texts with fences and words around them, some broken off."""
    text = F.expr(REPLY.format(end="end.").replace("VARCHAR", "STRING"))
    found = t.read("conversations").select("conv_id", "turn", jsons.salvaged(text).alias("object"))
    return found.select("conv_id", "turn", "object", F.get_json_object("object", "$.role").alias("role"))


@query("""WITH texts AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '{}' WHEN o_orderkey % 4 = 1 THEN '[]' ELSE '[' || CAST(o_orderkey AS VARCHAR) || ', ' || CAST(o_custkey AS VARCHAR) || ']' END AS text FROM orders)
SELECT o_orderkey, unnest(CASE WHEN json_type(text) = 'ARRAY' THEN CAST(json(text) AS BIGINT[]) ELSE [] END) AS item FROM texts""")
def json_items(t: Tables) -> DataFrame:
    """The elements of JSON arrays; other JSON has none."""
    text = F.expr("case when o_orderkey % 4 = 0 then '{}' when o_orderkey % 4 = 1 then '[]' else concat('[', o_orderkey, ', ', o_custkey, ']') end")
    return t.read("orders").select("o_orderkey", F.explode(jsons.items(text, "bigint")).alias("item"))


@query("""SELECT l_orderkey, '{' || string_agg('"p' || CAST(k AS VARCHAR) || '":' || CAST(n AS VARCHAR), ',' ORDER BY 'p' || CAST(k AS VARCHAR)) || '}' AS object
FROM (SELECT l_orderkey, l_partkey % 20 AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def sorted_json(t: Tables) -> DataFrame:
    """Counts of each order as JSON with sorted keys."""
    counts = t.read("lineitem").groupBy("l_orderkey", F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy("l_orderkey").agg(jsons.sorted_json(F.map_from_entries(F.collect_list(F.struct("k", "n")))).alias("object"))


@query("""SELECT id, CASE WHEN name IN ('ASIA', 'EUROPE') THEN name END AS role, strftime(timezone('UTC', timezone('America/New_York', created_at)), '%Y-%m-%d %H:%M:%S') AS created_utc FROM users JOIN roles r ON r.id = role_id""".replace("SELECT id,", "SELECT users.id,"))
def user_roles(t: Tables) -> DataFrame:
    """Known roles, others unknown, and local times in UTC."""
    rows = t.users.join(t.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
    return rows.select("id", jsons.known(F.col("role"), ("ASIA", "EUROPE")).alias("role"), jsons.in_utc(F.col("created_at"), "America/New_York").alias("created_utc"))


@query("""SELECT 'all' AS kind, src, dst FROM every_edge UNION ALL SELECT 'runtime', src, dst FROM live UNION ALL (SELECT 'type_only', src, dst FROM every_edge EXCEPT SELECT 'type_only', src, dst FROM live)""")
def graph_edge_metadata(t: Tables) -> DataFrame:
    return graph.edge_metadata(t.links)


FILE_EDGES = "pairs AS (SELECT a.scan_id, a.file_id AS source_file_id, b.file_id AS target_file_id FROM files a JOIN files b USING (scan_id) WHERE a.file_id % 3 = 0 AND b.file_id % 4 = 1 AND a.file_id <> b.file_id)"


def file_edges(t: Tables) -> DataFrame:
    some = t.files
    a, b = some.where("file_id % 3 = 0").select("scan_id", F.col("file_id").alias("source_file_id")), some.where("file_id % 4 = 1").select("scan_id", F.col("file_id").alias("target_file_id"))
    return a.join(b, "scan_id").where("source_file_id <> target_file_id")


@query(f"WITH {FILE_EDGES} SELECT p.scan_id, source_file_id, target_file_id, s.file_path AS source_path, t.file_path AS target_path FROM pairs p JOIN files s ON s.file_id = source_file_id JOIN files t ON t.file_id = target_file_id")
def dependency_graph(t: Tables) -> DataFrame:
    """Edges joined to both files."""
    return fl.dependency_edges(file_edges(t), t.files)


@query("""WITH members AS (SELECT scan_id, file_id % 3 AS group_id, file_id FROM files)
SELECT m.scan_id, m.group_id, count(*) AS size, string_agg(file_path, '|' ORDER BY file_path, f.file_id) AS paths FROM members m JOIN files f USING (file_id) GROUP BY m.scan_id, m.group_id""")
def circular_dependencies(t: Tables) -> DataFrame:
    members = t.files.selectExpr("scan_id", "file_id % 3 group_id", "file_id")
    return fl.circular_dependencies(members, t.files).select("scan_id", "group_id", "size", F.transform("members", lambda m: m["file_path"]).alias("paths"))


FILE = "(SELECT source_file_id FROM pairs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def busiest(edges: DataFrame) -> int | None:
    """The file with the most edges from it."""
    found = edges.groupBy("source_file_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file_id").head()
    return found[0] if found else None


@query(f"""WITH {FILE_EDGES}, edges AS (SELECT CASE WHEN source_file_id = {FILE} THEN target_file_id ELSE source_file_id END AS file_id, CASE WHEN source_file_id = {FILE} THEN 'outgoing' ELSE 'incoming' END AS direction
FROM pairs WHERE source_file_id = {FILE} OR target_file_id = {FILE})
SELECT file_id, direction, file_path, priority_band FROM edges JOIN files USING (file_id)""")
def file_dependencies(t: Tables) -> DataFrame:
    edges = file_edges(t)
    return fl.neighbours(edges, t.files, busiest(edges))


CO = "co AS (SELECT scan_id, least(source_file_id, target_file_id) AS a, greatest(source_file_id, target_file_id) AS b FROM pairs GROUP BY ALL)"


@query(f"WITH {FILE_EDGES}, {CO} SELECT f.file_id, file_path, priority_band FROM co JOIN files f ON f.file_id = CASE WHEN a = {FILE} THEN b ELSE a END WHERE a = {FILE} OR b = {FILE}")
def co_changed_files(t: Tables) -> DataFrame:
    one = busiest(file_edges(t))
    edges = file_edges(t).select("scan_id", F.least("source_file_id", "target_file_id").alias("file_id_a"), F.greatest("source_file_id", "target_file_id").alias("file_id_b")).distinct()
    return fl.co_changed(edges, t.files, one)


@query(f"""SELECT file_id, scan_id, file_path, CASE WHEN file_path LIKE '%.py' THEN 'Python' ELSE 'JavaScript' END AS language, CAST(refactor_score AS DOUBLE) AS refactor_score, priority_band, strftime(f.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS last_scan_at
FROM files f JOIN scans USING (scan_id) JOIN projects USING (project_id) WHERE status = 'succeeded' AND user_id = {USER} AND file_id = (SELECT max(file_id) FROM files JOIN scans USING (scan_id) JOIN projects USING (project_id) WHERE status = 'succeeded' AND user_id = {USER})""")
def file_details(t: Tables) -> DataFrame:
    own = t.scans.where("status = 'succeeded'").join(t.projects.where(F.col("user_id") == USER).select("project_id"), "project_id").select("scan_id")
    one = t.files.join(own, "scan_id", "left_semi").agg(F.max("file_id")).first()[0]
    return fl.file_details(t.scans, t.projects, t.files, one, USER)


@query(f"""WITH target AS (SELECT * FROM scans WHERE scan_id = {SCAN}), last AS (
SELECT s.* FROM scans s, target x WHERE s.project_id = x.project_id AND s.status = 'succeeded' AND s.finished_at IS NOT NULL AND (s.finished_at < x.finished_at OR (s.finished_at = x.finished_at AND s.scan_id <= x.scan_id)) ORDER BY s.finished_at DESC, s.scan_id DESC LIMIT 4)
SELECT l.scan_id, strftime(l.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, {PERCENT.format("avg(refactor_score)")} AS average_score FROM last l LEFT JOIN files f USING (scan_id) GROUP BY l.scan_id, l.finished_at""")
def overview_risk_trend(t: Tables) -> DataFrame:
    return fl.overview_trend(t.scans, t.files, SCAN)


@query(f"SELECT count(*) AS total_files, {BANDS} FROM files WHERE scan_id = {SCAN}")
def scan_summary(t: Tables) -> DataFrame:
    return fl.scan_summary(t.files, SCAN)


@query(f"SELECT file_id, file_path, {PERCENT.format('refactor_score')} AS risk_score, priority_band FROM (SELECT * FROM files WHERE scan_id = {SCAN} ORDER BY refactor_score DESC NULLS LAST, file_path LIMIT 5)")
def top_files(t: Tables) -> DataFrame:
    return fl.top_files(t.files, SCAN)


DIRECTORY = "coalesce(nullif(regexp_replace(file_path, '/?[^/]+$', ''), ''), '(root)')"


@query(f"SELECT {DIRECTORY} AS directory, count(*) FILTER (priority_band IN ('critical', 'high', 'medium')) AS risky_file_count, {BANDS} FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def risk_by_directory(t: Tables) -> DataFrame:
    return fl.risk_by_directory(t.files)


@query(f"""WITH rows AS (SELECT {DIRECTORY} AS path, file_path, priority_band, {PERCENT.format("refactor_score")} AS score FROM files), ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, file_path) AS n FROM rows)
SELECT path, count(*) FILTER (priority_band = 'critical') AS critical_files, count(*) FILTER (priority_band = 'high') AS high_files, round(avg(score), 2) AS average_score, string_agg(file_path, '|' ORDER BY n) FILTER (n <= 3) AS top_files
FROM ranked GROUP BY path ORDER BY critical_files + high_files DESC, average_score DESC, path LIMIT 5""")
def directory_insight(t: Tables) -> DataFrame:
    return fl.directory_insight(t.files)


@query("""WITH stats AS (SELECT project_id, count(*) AS n, avg(CASE WHEN finished_at >= started_at THEN (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 END) AS seconds FROM scans GROUP BY project_id),
rows AS (SELECT p.project_id, user_id, name, p.created_at, username, email, coalesce(n, 0) AS scan_count, round(seconds, 2) AS average_scan_duration_seconds FROM projects p JOIN users u ON u.id = p.user_id LEFT JOIN stats USING (project_id) WHERE name ILIKE '%1%')
SELECT project_id, user_id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, username, email, scan_count, average_scan_duration_seconds, total_count FROM
(SELECT *, (SELECT count(*) FROM rows) AS total_count FROM rows ORDER BY average_scan_duration_seconds DESC NULLS LAST, project_id DESC LIMIT 10)""")
def admin_projects(t: Tables) -> DataFrame:
    return pr.admin_projects(t.projects, t.users, t.scans, query=" 1 ", sort="scan_duration")


@query(f"""WITH state AS (SELECT project_id, bool_or(status = 'running') AS runs, arg_max(status, (created_at, scan_id)) AS latest FROM scans GROUP BY project_id)
SELECT project_id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN runs THEN 'running' ELSE latest END AS status FROM projects LEFT JOIN state USING (project_id) WHERE user_id = {USER}""")
def user_projects(t: Tables) -> DataFrame:
    return pr.user_projects(t.projects, t.scans, USER)


MONTHS = """WITH months AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1997-04-01', DATE '1998-06-01', INTERVAL 1 MONTH) g(d))
SELECT CAST(months.date AS VARCHAR) AS date, count({key}) AS count FROM months LEFT JOIN {table} ON date_trunc('month', created_at) = months.date GROUP BY months.date"""


@query(MONTHS.format(key="project_id", table="projects"))
def projects_over_time(t: Tables) -> DataFrame:
    return sc.timeline_months(t.projects, "created_at", AS_OF)


@query(MONTHS.format(key="id", table="users"))
def users_over_time(t: Tables) -> DataFrame:
    return sc.timeline_months(t.users, "created_at", AS_OF)


@query("""WITH every AS (SELECT 'users' AS entity, created_at AS moment FROM users UNION ALL SELECT 'projects', created_at FROM projects UNION ALL SELECT 'scans', created_at FROM scans UNION ALL SELECT 'files', created_at FROM files),
counts AS (SELECT entity, count(*) AS total, count(*) FILTER (moment >= TIMESTAMP '1998-05-16' AND moment < TIMESTAMP '1998-06-15') AS current_period_count, count(*) FILTER (moment >= TIMESTAMP '1998-04-16' AND moment < TIMESTAMP '1998-05-16') AS previous_period_count FROM every GROUP BY entity)
SELECT *, current_period_count - previous_period_count AS delta, round((current_period_count - previous_period_count) * 100.0 / nullif(previous_period_count, 0)::DOUBLE, 2) AS delta_percent FROM counts""")
def kpis(t: Tables) -> DataFrame:
    return pr.kpis({"users": (t.users, "created_at"), "projects": (t.projects, "created_at"), "scans": (t.scans, "created_at"), "files": (t.files, "created_at")}, AS_OF)


@query("""WITH rows AS (SELECT u.id, username, email, r.name AS role, u.created_at FROM users u LEFT JOIN roles r ON r.id = role_id WHERE username ILIKE '%a%' OR email ILIKE '%a%')
SELECT id, username, email, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, total_count FROM (SELECT *, (SELECT count(*) FROM rows) AS total_count FROM rows ORDER BY rows.created_at DESC, id DESC LIMIT 10)""")
def list_users(t: Tables) -> DataFrame:
    return pr.list_users(t.users, t.roles, query="a")


@query("SELECT scan_id, project_id, status FROM scans WHERE NOT EXISTS (SELECT 1 FROM projects p WHERE p.project_id = scans.project_id AND p.project_id % 4 <> 0)")
def orphan_scans(t: Tables) -> DataFrame:
    """Anti join: scans whose project is gone."""
    return pr.orphans(t.scans, t.projects.where("project_id % 4 <> 0"), "project_id").select("scan_id", "project_id", "status")


@query("SELECT scan_id, count(*) AS vector_count, count(DISTINCT file_path) AS file_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS captured_at FROM records GROUP BY scan_id")
def visualization_runs(t: Tables) -> DataFrame:
    return sn.runs(t.records)


@query("SELECT arg_max(scan_id, (created_at, scan_id)) AS scan_id FROM records")
def latest_run(t: Tables) -> DataFrame:
    return sn.latest_run(t.records)


@query("""SELECT scan_id, file_path, string_agg(layer || ':' || CAST(turn AS VARCHAR), '|' ORDER BY CASE layer WHEN 'static' THEN 0 WHEN 'history' THEN 1 WHEN 'duplication' THEN 2 WHEN 'architecture' THEN 3 WHEN 'decision' THEN 4 ELSE 100 END, layer, created_at, turn) AS layers
FROM records GROUP BY scan_id, file_path""")
def snapshot(t: Tables) -> DataFrame:
    """Records of each file in the order of their layers."""
    rows = sn.snapshot_files(t.records.withColumn("metrics", F.col("turn")))
    return rows.select("scan_id", "file_path", F.transform("layers", lambda x: F.concat_ws(":", x["layer"], x["metrics"].cast("string"))).alias("layers"))


@query("SELECT item_id, project_id, status, CAST(row_number() OVER (PARTITION BY project_id, status ORDER BY position, item_id) - 1 AS INTEGER) AS position FROM items")
def refactor_queue_positions(t: Tables) -> DataFrame:
    return sn.queue_positions(t.items)


@query("SELECT CAST(coalesce(max(position), -1) + 1 AS INTEGER) AS position FROM items WHERE project_id = 3 AND status = 'todo'")
def refactor_queue_next(t: Tables) -> DataFrame:
    return sn.next_position(t.items, 3, "todo")


@query("SELECT scan_id, file_id, file_path, created, status FROM (SELECT scan_id, file_id, file_path, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, status FROM (SELECT f.*, s.status, row_number() OVER (PARTITION BY file_path ORDER BY f.created_at DESC, file_id DESC) AS n FROM files f JOIN scans s USING (scan_id)) WHERE n = 1)")
def latest_file_rows(t: Tables) -> DataFrame:
    """The newest row of each path."""
    rows = t.files.join(t.scans.select("scan_id", "status"), "scan_id")
    return sc.last_of_each(rows, "file_path", "created_at", "file_id").select("scan_id", "file_id", "file_path", F.col("created_at").alias("created"), "status")


# Graphs

REACH = "reach AS (WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM live UNION SELECT r.src, e.dst FROM r JOIN live e ON r.dst = e.src) SELECT * FROM r)"


@query("""SELECT n.node, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out, coalesce(round(coalesce(o, 0)::DOUBLE / nullif(coalesce(i, 0) + coalesce(o, 0), 0), 3), 0.0) AS instability_index
FROM nodes n LEFT JOIN (SELECT dst AS node, count(*) AS i FROM live GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM live GROUP BY 1) USING (node)""")
def graph_degrees(t: Tables) -> DataFrame:
    return graph.degrees(t.nodes, graph.runtime(t.links))


@query("SELECT src, dst FROM every_edge EXCEPT SELECT src, dst FROM live")
def graph_type_only_edges(t: Tables) -> DataFrame:
    return graph.type_only(t.links)


@query(f"WITH {REACH} SELECT src, dst FROM reach")
def graph_closure(t: Tables) -> DataFrame:
    return graph.closure(graph.runtime(t.links))


@query(f"WITH {REACH} SELECT node, count(src) AS transitive_dependents_count FROM nodes LEFT JOIN reach ON dst = node AND src <> dst GROUP BY node")
def graph_dependents(t: Tables) -> DataFrame:
    return graph.dependents(t.nodes, graph.runtime(t.links))


@query(f"""WITH {REACH}, mutual AS (SELECT a.src AS node, least(min(a.dst), a.src) AS cycle_id, count(*) + 1 AS n FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT node, cycle_id, coalesce(n, 0) AS circular_dependency_size FROM nodes LEFT JOIN mutual USING (node)""")
def graph_cycles(t: Tables) -> DataFrame:
    return graph.cycles(t.nodes, graph.runtime(t.links))


@query()
def graph_betweenness(t: Tables) -> DataFrame:
    return graph.betweenness(t.nodes, graph.runtime(t.links))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS k, 'src/pkg' || CAST(l_partkey % 5 AS VARCHAR) || '/mod' || CAST(l_partkey % 50 AS VARCHAR) || CASE WHEN l_partkey % 7 = 0 THEN '/__init__.py' ELSE '.py' END AS path FROM lineitem)
SELECT DISTINCT path, 'pkg' || CAST(k % 5 AS VARCHAR) || '.mod' || CAST(k % 50 AS VARCHAR) AS module FROM m""")
def module_names(t: Tables) -> DataFrame:
    rows = t.read("lineitem").selectExpr("concat('src/pkg', l_partkey % 5, '/mod', l_partkey % 50, case when l_partkey % 7 = 0 then '/__init__.py' else '.py' end) path").distinct()
    return rows.select("path", paths.module_name(F.col("path")).alias("module"))


@query("""WITH named AS (SELECT DISTINCT 'a.b' || CAST(p_partkey % 30 AS VARCHAR) AS module FROM part WHERE p_partkey % 30 < 20 UNION SELECT 'a' AS module),
used AS (SELECT DISTINCT l_suppkey AS path, 'a.b' || CAST(l_partkey % 30 AS VARCHAR) || '.c' AS candidate FROM lineitem)
SELECT path, candidate, arg_max(module, length(module)) AS module FROM used JOIN named ON starts_with(candidate || '.', module || '.') GROUP BY path, candidate""")
def import_prefixes(t: Tables) -> DataFrame:
    """Longest known prefix of dotted names."""
    some = t.read("part").where("p_partkey % 30 < 20").selectExpr("concat('a.b', p_partkey % 30) module").distinct()
    named = some.union(t.spark.createDataFrame([("a",)], "module string")).withColumn("path", F.col("module"))
    used = t.read("lineitem").selectExpr("cast(l_suppkey as string) path", "concat('a.b', l_partkey % 30, '.c') candidate").distinct()
    rows = used.selectExpr("path", "cast(hash(candidate) as int) statement", "0 ordinal", "candidate", "true is_runtime")
    return graph.resolve_imports(rows.withColumn("path", F.concat_ws(" ", "path", "candidate")), named).select(F.split("src", " ")[0].cast("long").alias("path"), F.split("src", " ")[1].alias("candidate"), F.col("dst").alias("module"))


# History

CHANGES = """WITH touched AS (SELECT path, hash, sum(coalesce(try_cast(added AS BIGINT), 0) + coalesce(try_cast(deleted AS BIGINT), 0)) AS churn FROM commit_files GROUP BY path, hash),
changes AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos DESC, hash DESC) AS age, row_number() OVER (PARTITION BY path ORDER BY pos, hash) AS recency FROM touched JOIN commits USING (hash)),
sizes AS (SELECT hash, count(DISTINCT path) AS files FROM commit_files GROUP BY hash),
peers AS (SELECT DISTINCT c.path, f.path AS peer FROM changes c JOIN sizes s USING (hash) JOIN commit_files f USING (hash) WHERE age > 1 AND recency <= 20 AND s.files <= 6 AND c.path <> f.path)
"""


@query(CHANGES + """SELECT path, count(DISTINCT trim(email)) AS contributors_count, count(*) AS update_count, count(*) FILTER (ts >= TIMESTAMP '2000-10-01') AS recent_update_count, count(*) - count(*) FILTER (ts >= TIMESTAMP '2000-10-01') AS historical_update_count,
round(count(*) FILTER (ts >= TIMESTAMP '2000-10-01') / count(*)::DOUBLE, 3) AS recent_to_lifetime_update_ratio, CAST(sum(churn) AS BIGINT) AS churn_rate, round(CAST(sum(churn) AS DOUBLE), 3) AS churn_to_size_ratio,
count(*) FILTER (age > 1 AND regexp_matches(lower(subject), 'fix|bug|issue|patch|repair|correct|defect')) AS bug_fix_commit_count,
coalesce(round(count(*) FILTER (age > 1 AND regexp_matches(lower(subject), 'fix|bug|issue|patch|repair|correct|defect')) / nullif(count(*) - 1, 0)::DOUBLE, 3), 0.0) AS bug_fix_ratio,
coalesce(max(n), 0) AS co_change_file_count, count(*) FILTER (age > 1 AND recency <= 20) AS commits_analyzed, count(*) FILTER (age > 1 AND recency <= 20 AND files > 6) AS bulk_commits_skipped
FROM changes JOIN sizes USING (hash) LEFT JOIN (SELECT path, count(*) AS n FROM peers GROUP BY path) USING (path) GROUP BY path""")
def history_metrics(t: Tables) -> DataFrame:
    return history.history_metrics(t.commits, t.commit_files, datetime(2001, 1, 1), newest=20, bulk=6).drop("co_changed_sample")


@query(CHANGES + "SELECT path, peer FROM peers")
def co_change_pairs(t: Tables) -> DataFrame:
    return history.co_changes(t.commits, t.commit_files, newest=20, bulk=6)


# Duplication

@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(round(list_dot_product(a.v, b.v), 6), 5) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_dot_product(a.v, b.v) >= 0.35""")
def semantic_matches(t: Tables) -> DataFrame:
    rows = duplication.semantic_matches(t.read("embeddings"), 0.35, "vec_id", "label")
    return rows.select("id_a", "id_b", F.round("similarity", 5).alias("similarity"))


TOKENS = "tokens AS (SELECT doc_id, source, regexp_split_to_array(text, '\\s+') AS tokens FROM documents)"


@query(f"""WITH {TOKENS}, groups AS (SELECT tokens, count(DISTINCT source) AS files, min(doc_id) AS first_id, count(*) AS blocks FROM tokens GROUP BY tokens)
SELECT first_id, blocks, files FROM groups WHERE files > 1""")
def equal_token_blocks(t: Tables) -> DataFrame:
    """Groups of blocks with equal tokens in more than one file."""
    rows = t.read("documents").select("doc_id", "source", F.split("text", r"\s+").alias("tokens"))
    return rows.groupBy("tokens").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("blocks"), F.countDistinct("source").alias("files")).where("files > 1").drop("tokens")


@query()
def near_token_blocks(t: Tables) -> DataFrame:
    """Pairs of groups of blocks whose token lists match by sequence."""
    rows = t.read("documents").select(F.col("source").alias("path"), F.col("doc_id").alias("block"), F.split("text", r"\s+").alias("tokens"))
    groups = duplication.token_groups(rows)
    named = groups.select("gid", F.col("first.block").alias("b"))
    pairs = duplication.near_groups(groups).join(named.toDF("gid_a", "block_a"), "gid_a").join(named.toDF("gid_b", "block_b"), "gid_b")
    return pairs.select("block_a", "block_b", F.round("similarity", 6).alias("similarity"))


# Scores

METRICS = {
    "lines_of_code": "sum(l_quantity)", "source_lines_of_code": "sum(l_quantity) * 0.8", "logical_lines_of_code": "max(CASE WHEN l_returnflag = 'R' THEN l_quantity END)", "max_cyclomatic_complexity": "max(l_quantity) / 2", "average_cyclomatic_complexity": "min(l_quantity) / 4",
    "max_cognitive_complexity": "max(CASE WHEN l_returnflag = 'A' THEN l_quantity END)", "long_conditions_count": "count(*)", "max_if_else_chain_length": "max(l_linenumber)", "average_parameters_count": "min(l_linenumber)", "count_of_fixme_comments": "min(l_linenumber) * 2", "testing_coverage": "max(l_discount) * 1000",
    "update_count": "count(*)", "recent_update_count": "count(CASE WHEN l_returnflag = 'N' THEN 1 END)", "churn_to_size_ratio": "max(l_tax) * 100", "bug_fix_ratio": "min(l_discount) * 5", "bug_fix_commit_count": "max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END)", "co_change_file_count": "max(l_linenumber) + 4", "contributors_count": "count(DISTINCT l_suppkey)",
    "duplicate_loc_count": "min(l_quantity)", "duplicate_blocks_count": "min(l_linenumber)", "duplication_group_size": "max(l_linenumber) - 2", "duplicate_file_candidates_count": "max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END)", "max_similarity_score": "max(CASE WHEN l_returnflag = 'A' THEN 0.7 + l_discount * 3 END)",
    "fan_in": "count(*) / 2", "fan_out": "max(l_linenumber) * 2", "runtime_circular_dependency_size": "min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END)", "circular_dependency_size": "max(l_linenumber)", "transitive_dependents_count": "count(*)", "instability_index": "max(l_discount) * 8",
}


def metric_rows(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy("l_partkey").agg(*(F.expr(f"cast({e} as double)").alias(n) for n, e in METRICS.items()))


def score_sql() -> str:
    """The scores in SQL: each component as a weighted mean of what is known."""
    num = lambda n: n if n in METRICS else "CAST(NULL AS DOUBLE)"
    clamp = lambda x: f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END)"
    pos = lambda x: f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, {x}) END)"
    sat = lambda x, s: clamp(f"({x}) / {float(s)}")
    off = lambda n, o, s: sat(pos(f"{num(n)} - {o}"), s)
    dens = lambda n, s: sat(f"{pos(num(n))} * 500.0 / greatest(1.0, physical)", s)
    parts = {
        "complexity": [(0.18, sat(pos("max_cyclomatic_complexity"), 15)), (0.18, sat(pos("max_cognitive_complexity"), 25)), (0.07, sat(pos("average_cyclomatic_complexity"), 8)), (0.07, sat(num("average_cognitive_complexity"), 12)), (0.18, sat("physical", 300)), (0.07, dens("long_conditions_count", 5)),
                       (0.06, off("max_if_else_chain_length", 1, 5)), (0.07, off("average_parameters_count", 3, 4)), (0.06, dens("count_of_fixme_comments", 5)), (0.04, num("count_of_empty_except_blocks")), (0.02, f"1 - {clamp('testing_coverage / 100')}")],
        "history": [(0.25, sat("churn_to_size_ratio", 8)), (0.18, sat("rc", 12)), (0.18, sat("bug_fix_ratio * (changes / (changes + 2))", 0.5)), (0.12, num("cyclomatic_complexity_growth_rate")), (0.10, sat("bug_fix_commit_count", 6)), (0.10, sat("co_change_file_count", 12)), (0.04, off("contributors_count", 1, 5)),
                    (0.03, f"(CASE WHEN rc IS NOT NULL AND changes > 0 THEN {clamp('rc / changes')} WHEN changes = 0 THEN 0.0 END)")],
        "duplication": [(0.24, f"{clamp('duplicate_loc_count / greatest(1.0, code)')} * {sat('duplicate_loc_count', 30)}"), (0.22, sat("duplicate_blocks_count", 4)), (0.22, num("semantic_duplicate_blocks_count")), (0.12, off("duplication_group_size", 1, 4)), (0.10, sat("duplicate_file_candidates_count", 5)), (0.10, off("max_similarity_score", 0.75, 0.25))],
        "architecture": [(0.18, off("runtime_circular_dependency_size", 1, 2)), (0.05, off("circular_dependency_size", 1, 2)), (0.15, num("betweenness_centrality")), (0.14, sat("transitive_dependents_count", 30)), (0.30, sat("fan_out", 15)), (0.12, sat("fan_in", 15)), (0.06, clamp("instability_index"))],
    }

    def weighted(items, known=lambda x: x):
        cover = " + ".join(["0.0", *(f"(CASE WHEN ({x}) IS NOT NULL THEN {w} ELSE 0.0 END)" for w, x in items)])
        total = " + ".join(["0.0", *(f"(CASE WHEN ({x}) IS NOT NULL THEN ({x}) * {w} ELSE 0.0 END)" for w, x in items)])
        return cover, total

    columns = []
    for name, items in parts.items():
        cover, total = weighted(items)
        columns.append(f"{cover} AS {name}_cover, {total} AS {name}_total")
    mean = lambda n: f"CASE WHEN {n}_cover > 0 THEN greatest(0.0, least(1.0, CASE WHEN abs({n}_cover - 1) <= 1e-9 THEN {n}_total ELSE {n}_total / {n}_cover END)) END"
    scores = ", ".join(f"CASE WHEN {n}_cover >= 0.5 - 1e-12 THEN round({mean(n)}, 6) END AS {n}_score" for n in parts)
    base_cover, base_total = weighted([(w, f"{n}_score") for n, w in scoring.COMPONENTS.items()])
    excess = ", ".join(f"coalesce({scoring.DOMINANCE[n]} * {pos(f'{n}_score - base_score')}, 0.0)" for n in parts)
    confidence = " + ".join(["0.0", *(f"{w} * {n}_cover" for n, w in scoring.COMPONENTS.items())])
    metrics = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in METRICS.items()).replace("count(*) / 2", "count(*)::DOUBLE / 2")
    return f"""WITH metrics AS (SELECT l_partkey, {metrics} FROM lineitem GROUP BY l_partkey),
derived AS (SELECT *, greatest(lines_of_code, source_lines_of_code, logical_lines_of_code) AS physical, coalesce(source_lines_of_code, logical_lines_of_code, lines_of_code) AS code, greatest(0.0, update_count - 1) AS changes, least(greatest(0.0, recent_update_count), greatest(0.0, update_count - 1)) AS rc FROM metrics),
parts AS (SELECT l_partkey, {", ".join(columns)} FROM derived),
scores AS (SELECT *, {scores} FROM parts),
bases AS (SELECT *, CASE WHEN ({base_cover}) > 0 THEN greatest(0.0, least(1.0, CASE WHEN abs(({base_cover}) - 1) <= 1e-9 THEN {base_total} ELSE ({base_total}) / ({base_cover}) END)) END AS base_score FROM scores),
final AS (SELECT l_partkey, complexity_score, history_score, duplication_score, architecture_score, round({clamp(f"base_score + 0.65 * greatest({excess})")}, 6) AS refactor_score, round(CAST({confidence} AS DOUBLE), 6) AS score_confidence FROM bases)
"""


BAND_CASE = "CASE WHEN refactor_score IS NULL THEN NULL WHEN refactor_score >= 0.7 THEN 'critical' WHEN refactor_score >= 0.55 THEN 'high' WHEN refactor_score >= 0.31 THEN 'medium' ELSE 'low' END"


@query(score_sql() + f"SELECT *, {BAND_CASE} AS priority_band FROM final")
def refactor_scores(t: Tables) -> DataFrame:
    rows = scoring.score_files(metric_rows(t))
    return rows.select("l_partkey", *(f"{c}_score" for c in scoring.COMPONENTS), "refactor_score", "score_confidence", "priority_band")


@query(score_sql() + f"""SELECT count(*) AS files_evaluated, count(refactor_score) AS files_scored, count(*) - count(refactor_score) AS files_unscored, round(avg(refactor_score), 6) AS average_score, max(refactor_score) AS max_score,
{", ".join(f"count(*) FILTER (({BAND_CASE}) = '{b}') AS {b}_count" for b in ("critical", "high", "medium", "low"))},
(SELECT string_agg(file_path, '|' ORDER BY refactor_score DESC, file_path) FROM (SELECT CAST(l_partkey AS VARCHAR) AS file_path, refactor_score FROM final WHERE refactor_score IS NOT NULL ORDER BY refactor_score DESC, CAST(l_partkey AS VARCHAR) LIMIT 10)) AS top_candidates FROM final""")
def score_summary(t: Tables) -> DataFrame:
    return scoring.summarise(scoring.score_files(metric_rows(t)).withColumn("file_path", F.col("l_partkey").cast("string")))


# Store

@query("""WITH rows AS (SELECT DISTINCT l_orderkey AS scan_id, l_partkey % 50 AS path, l_returnflag AS layer FROM lineitem)
SELECT scan_id, path, string_agg(layer, '|' ORDER BY layer) AS layers, count(*) AS n FROM rows GROUP BY scan_id, path""")
def file_payloads(t: Tables) -> DataFrame:
    rows = t.read("lineitem").selectExpr("l_orderkey scan_id", "l_partkey % 50 path", "l_returnflag layer").distinct()
    vectors = rows.select("*", F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(float("nan"))).alias("metrics"), F.array().cast("array<string>").alias("errors"))
    out = store.file_payloads(rows, vectors)
    return out.select("scan_id", "path", F.sort_array(F.map_keys("metrics")).alias("layers"), F.size("metrics").cast("long").alias("n"))


@query("""WITH named AS (SELECT DISTINCT l_orderkey AS scan_id, 'p' || CAST(l_partkey % 50 AS VARCHAR) AS path, l_orderkey * 100 + l_partkey % 50 AS file_id FROM lineitem),
raw AS (SELECT l_orderkey AS scan_id, 'p' || CAST(l_partkey % 50 AS VARCHAR) AS s, 'p' || CAST(l_suppkey % 50 AS VARCHAR) AS t FROM lineitem)
SELECT DISTINCT r.scan_id, a.file_id AS source_file_id, b.file_id AS target_file_id FROM raw r JOIN named a ON a.scan_id = r.scan_id AND a.path = s JOIN named b ON b.scan_id = r.scan_id AND b.path = t WHERE s <> t""")
def stored_dependency_edges(t: Tables) -> DataFrame:
    some = t.read("lineitem")
    named = some.selectExpr("l_orderkey scan_id", "concat('p', l_partkey % 50) path", "l_orderkey * 100 + l_partkey % 50 file_id").distinct()
    return store.dependency_edges(named, some.selectExpr("l_orderkey scan_id", "array(concat('p', l_partkey % 50), concat('p', l_suppkey % 50)) pair"))


@query("""WITH nodes2 AS (SELECT DISTINCT l_orderkey AS scan_id, l_partkey % 3 AS group_id, l_partkey AS file_id FROM lineitem WHERE l_partkey % 10 <> 0), sized AS (SELECT scan_id, group_id, count(*) AS size FROM nodes2 GROUP BY ALL HAVING count(*) > 1)
SELECT scan_id, group_id, file_id, size FROM nodes2 JOIN sized USING (scan_id, group_id)""")
def stored_cycle_members(t: Tables) -> DataFrame:
    rows = t.read("lineitem")
    named = rows.where("l_partkey % 10 <> 0").selectExpr("l_orderkey scan_id", "cast(l_partkey as string) path", "l_partkey file_id").distinct()
    groups = rows.groupBy(F.col("l_orderkey").alias("scan_id"), F.expr("l_partkey % 3").alias("group_id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("nodes"))
    return store.cycle_members(named, groups)


@query(CHANGES + "SELECT 1 AS scan_id, least(a, b) AS file_id_a, greatest(a, b) AS file_id_b FROM (SELECT CAST(substr(path, 2) AS BIGINT) AS a, CAST(substr(peer, 2) AS BIGINT) AS b FROM peers) GROUP BY ALL")
def stored_co_change_edges(t: Tables) -> DataFrame:
    raw = history.co_changes(t.commits, t.commit_files, newest=20, bulk=6).withColumn("scan_id", F.lit(1))
    named = t.commit_files.select(F.lit(1).alias("scan_id"), "path", F.substring("path", 2, 20).cast("long").alias("file_id")).distinct()
    return store.co_change_edges(named, raw)


# Functions

@query("""SELECT page_id, regexp_extract(regexp_replace(url, '^https?://[^/]+/', ''), '^[^?#]*') AS path, coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(url, '^https?://[^/]+/', ''), '^[^?#]*'), '/?[^/]+$', ''), ''), '(root)') AS directory FROM pages""")
def path_directories(t: Tables) -> DataFrame:
    path = F.regexp_extract(F.regexp_replace("url", "^https?://[^/]+/", ""), "^[^?#]*", 0)
    return t.read("pages").select("page_id", path.alias("path"), paths.directory(path).alias("directory"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.none') AS BIGINT), 0) AS missing FROM events")
def json_properties(t: Tables) -> DataFrame:
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.none", "bigint"), F.lit(0)).cast("long").alias("missing"))


@query(f"SELECT file_id, {PERCENT.format('refactor_score')} AS risk FROM files")
def percent_scores(t: Tables) -> DataFrame:
    return t.files.select("file_id", percent(F.col("refactor_score")).alias("risk"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_day(t: Tables) -> DataFrame:
    """Extension: the streaming windows over the whole table."""
    from ..streaming.events import windowed_counts

    return windowed_counts(t.events).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scores of all files."""
    return QUERIES["refactor_scores"](spark, sf_dir)


from . import operations  # noqa: E402, F401  registers more queries
