"""Queries over projects, users and key figures."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import page

SORTS = ("created_at", "name", "owner", "scan_count", "scan_duration")


def valid_seconds(start: str = "started_at", end: str = "finished_at") -> Column:
    """Seconds from start to end; null where either is missing or they are reversed."""
    return F.when(F.col(end) >= F.col(start), (F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def admin_projects(projects: DataFrame, users: DataFrame, scans: DataFrame, query: str | None = None, sort: str = "created_at", descending: bool = True, number: int = 1, limit: int = 10) -> DataFrame:
    """Projects with owner, scans and mean duration; unknown durations last in both directions."""
    rows = projects.join(users.select(F.col("id").alias("user_id"), "username", "email"), "user_id")
    if query and query.strip():
        rows = rows.where(F.col("name").ilike(f"%{query.strip()}%"))
    stats = scans.groupBy("project_id").agg(F.count("*").alias("n"), F.avg(valid_seconds()).alias("seconds"))
    rows = rows.join(stats, "project_id", "left").select("project_id", "user_id", "name", "created_at", "username", "email", F.coalesce("n", F.lit(0)).cast("long").alias("scan_count"), F.round("seconds", 2).alias("average_scan_duration_seconds"))
    key = {"created_at": F.col("created_at"), "name": F.lower("name"), "owner": F.lower("username"), "scan_count": F.col("scan_count"), "scan_duration": F.col("average_scan_duration_seconds")}[sort]
    order = [key.desc_nulls_last(), F.desc("project_id")] if descending else [key.asc_nulls_last(), F.asc("project_id")]
    return page(rows, number, limit, *order)


def user_projects(projects: DataFrame, scans: DataFrame, user_id) -> DataFrame:
    """A user's projects with their state: running if any scan runs, else that of the latest scan, null without scans."""
    state = scans.groupBy("project_id").agg(F.max(F.col("status") == "running").alias("runs"), F.max_by("status", F.struct("created_at", "scan_id")).alias("latest"))
    rows = projects.where(F.col("user_id") == user_id).join(state, "project_id", "left")
    return rows.select("project_id", "name", "created_at", F.when(F.col("runs"), "running").otherwise(F.col("latest")).alias("status"))


def list_users(users: DataFrame, roles: DataFrame, query: str | None = None, role: str | None = None, number: int = 1, limit: int = 10) -> DataFrame:
    rows = users.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id", "left")
    if role:
        rows = rows.where(F.col("role") == role)
    if query is not None:
        rows = rows.where(F.col("username").ilike(f"%{query.strip()}%") | F.col("email").ilike(f"%{query.strip()}%"))
    return page(rows.select("id", "username", "email", "role", "created_at"), number, limit, F.desc_nulls_last("created_at"), F.desc("id"))


def kpis(tables: dict[str, tuple[DataFrame, str]], as_of: datetime | date, days: int = 30) -> DataFrame:
    """For each entity all rows up to as_of, those of the period to it and of the one before, and the change; per cent unknown where there were none."""
    out = []
    start, earlier = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    at = lambda t: F.lit(t).cast("timestamp")
    for name, (df, ts) in tables.items():
        c = F.col(ts)
        out.append(df.agg(F.lit(name).alias("entity"), F.count("*").alias("total"), F.count_if((c >= at(start)) & (c < at(as_of))).alias("current_period_count"), F.count_if((c >= at(earlier)) & (c < at(start))).alias("previous_period_count")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    delta = F.col("current_period_count") - F.col("previous_period_count")
    return rows.withColumn("delta", delta).withColumn("delta_percent", F.round(F.try_divide(delta * 100.0, F.col("previous_period_count").cast("double")), 2))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone."""
    return rows.join(parents.select(key), key, "left_anti")
