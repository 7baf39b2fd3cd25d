"""Tables of the engine's concepts made from star-schema tables, in DataFrame form and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} >= 0.7 THEN 'critical' WHEN {0} >= 0.55 THEN 'high' WHEN {0} >= 0.31 THEN 'medium' ELSE 'low' END"

SQL = """WITH users AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS username, lower(n_name) || '@example.com' AS email, CAST(n_regionkey AS BIGINT) AS role_id, TIMESTAMP '1995-01-15' + to_days(CAST(n_nationkey * 90 AS INTEGER)) AS created_at FROM nation),
roles AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
projects AS (
  SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS created_at FROM customer),
base AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'pending' END AS status FROM orders),
scans AS (
  SELECT o_orderkey AS scan_id, o_custkey AS project_id, status, o_orderdate AS created_at, CASE WHEN status <> 'pending' THEN o_orderdate END AS started_at,
         CASE WHEN status IN ('succeeded', 'failed') THEN o_orderdate + to_seconds(CAST(o_orderkey % 1000 - 10 AS DOUBLE)) END AS finished_at, o_orderdate AS updated_at, CASE WHEN status = 'failed' THEN 'e' || CAST(o_orderkey % 7 AS VARCHAR) END AS error_message FROM base),
scored AS (
  SELECT l_orderkey AS scan_id, l_partkey, round(max(CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END), 5) AS refactor_score, max(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey, l_partkey),
files AS (
  SELECT scan_id * 1000000 + l_partkey AS file_id, scan_id, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'src/m' || CAST(l_partkey % 7 AS VARCHAR) || '/' END || 'f' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey % 5 = 0 THEN '.JS' ELSE '.py' END AS file_path,
         refactor_score, {band} AS priority_band, created_at FROM scored),
links AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_linenumber % 3 <> 0 AS is_runtime FROM lineitem),
nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links),
live AS (SELECT DISTINCT src, dst FROM links WHERE is_runtime AND src <> dst),
every_edge AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst),
commits AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS hash, ' c' || CAST(o_custkey % 40 AS VARCHAR) AS email, o_orderdate AS ts, CASE WHEN o_orderkey % 5 = 0 THEN 'Fix build' WHEN o_orderkey % 5 = 1 THEN 'prefix change' ELSE 'feature' END AS subject,
         CAST(date_diff('day', o_orderdate, TIMESTAMP '2100-01-01') AS BIGINT) * 1000000007 + o_orderkey * 7919 % 1000000007 AS pos FROM orders),
commit_files AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS hash, 'p' || CAST(l_partkey AS VARCHAR) AS path, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS added, CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(l_linenumber AS VARCHAR) END AS deleted FROM lineitem),
records AS (
  SELECT conv_id AS scan_id, CASE role WHEN 'user' THEN 'static' WHEN 'assistant' THEN 'decision' ELSE role END AS layer, CASE WHEN turn > 0 THEN 'f' || CAST(turn % 3 AS VARCHAR) END AS file_path, TIMESTAMP '2024-01-01' + to_seconds(CAST(turn * 60 + conv_id * 7 AS DOUBLE)) AS created_at, turn FROM conversations),
items AS (
  SELECT o_orderkey AS item_id, o_custkey % 20 AS project_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in_progress' ELSE 'todo' END AS status, CAST(o_orderkey % 13 AS INTEGER) AS position FROM orders)
""".format(band=BAND.format("refactor_score"))


class Tables:
    """The same tables as lazily made DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def users(self) -> DataFrame:
        return self.read("nation").selectExpr("cast(n_nationkey as bigint) id", "n_name username", "concat(lower(n_name), '@example.com') email", "cast(n_regionkey as bigint) role_id", "timestampadd(DAY, n_nationkey * 90, timestamp'1995-01-15') created_at")

    @property
    def roles(self) -> DataFrame:
        return self.read("region").selectExpr("cast(r_regionkey as bigint) id", "r_name name")

    @property
    def projects(self) -> DataFrame:
        return self.read("customer").selectExpr("c_custkey project_id", "cast(c_nationkey as bigint) user_id", "c_name name", "timestampadd(DAY, cast(c_custkey % 2000 as int), timestamp'1995-01-01') created_at")

    @property
    def scans(self) -> DataFrame:
        status = "case when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'O' then 'running' when o_orderkey % 3 = 0 then 'failed' else 'pending' end"
        base = self.read("orders").selectExpr("*", f"{status} status", "cast(o_orderdate as timestamp) at")
        return base.selectExpr(
            "o_orderkey scan_id", "o_custkey project_id", "status", "at created_at", "case when status <> 'pending' then at end started_at",
            "case when status in ('succeeded', 'failed') then timestampadd(SECOND, cast(o_orderkey % 1000 - 10 as int), at) end finished_at", "at updated_at", "case when status = 'failed' then concat('e', o_orderkey % 7) end error_message",
        )

    @property
    def files(self) -> DataFrame:
        score = F.round(F.max(F.expr("case when l_returnflag <> 'N' then l_discount * 10 end")), 5)
        scored = self.read("lineitem").groupBy(F.col("l_orderkey").alias("scan_id"), "l_partkey").agg(score.alias("refactor_score"), F.max("l_shipdate").cast("timestamp").alias("created_at"))
        path = "concat(case when l_partkey % 11 = 0 then '' else concat('src/m', l_partkey % 7, '/') end, 'f', l_partkey, case when l_partkey % 5 = 0 then '.JS' else '.py' end) file_path"
        return scored.selectExpr("scan_id * 1000000 + l_partkey file_id", "scan_id", path, "refactor_score", f"{BAND.format('refactor_score')} priority_band", "created_at")

    @property
    def links(self) -> DataFrame:
        """A part and a supplier of one number are one node."""
        return self.read("lineitem").selectExpr("l_partkey src", "l_suppkey dst", "l_linenumber % 3 <> 0 is_runtime").distinct()

    @property
    def nodes(self) -> DataFrame:
        links = self.links
        return links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()

    @property
    def commits(self) -> DataFrame:
        """The log's order follows the days, and within a day neither hash nor key."""
        return self.read("orders").selectExpr("cast(o_orderkey as string) hash", "concat(' c', o_custkey % 40) email", "cast(o_orderdate as timestamp) ts", "case when o_orderkey % 5 = 0 then 'Fix build' when o_orderkey % 5 = 1 then 'prefix change' else 'feature' end subject",
            "cast(datediff(date'2100-01-01', cast(o_orderdate as date)) as bigint) * 1000000007 + o_orderkey * 7919 % 1000000007 pos")

    @property
    def commit_files(self) -> DataFrame:
        return self.read("lineitem").selectExpr("cast(l_orderkey as string) hash", "concat('p', l_partkey) path", "cast(cast(l_quantity as bigint) as string) added", "case when l_linenumber % 4 = 0 then '-' else cast(l_linenumber as string) end deleted")

    @property
    def records(self) -> DataFrame:
        return self.read("conversations").selectExpr(
            "conv_id scan_id", "case role when 'user' then 'static' when 'assistant' then 'decision' else role end layer", "case when turn > 0 then concat('f', turn % 3) end file_path",
            "timestampadd(SECOND, cast(turn * 60 + conv_id * 7 as int), timestamp'2024-01-01') created_at", "map('turn', cast(turn as double)) metrics", "turn",
        )

    @property
    def items(self) -> DataFrame:
        return self.read("orders").selectExpr("o_orderkey item_id", "o_custkey % 20 project_id", "case o_orderstatus when 'F' then 'done' when 'O' then 'in_progress' else 'todo' end status", "cast(o_orderkey % 13 as int) position")

    @property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, lists joined by '|', so that results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(name))
    return df.select(*out)
