"""Queries over scans. users(id, username, email), projects(project_id, user_id, name), scans(scan_id, project_id, status, created_at, started_at, finished_at, updated_at, error_message), files(scan_id, file_path, refactor_score, priority_band)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percent

#: States of a scan (fixed values).
STATUSES = ("pending", "running", "succeeded", "failed", "cancelled")
#: Scans in the dashboards' history.
HISTORY = 20


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal all filters given; None is no filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def between(c: Column, start, before) -> Column:
    """start <= c < before; None is no bound."""
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start))
    if before is not None:
        out = out & (c < F.lit(before))
    return out


def page(df: DataFrame, number: int, limit: int, *order: Column) -> DataFrame:
    """One page in a total order, with the count of all rows."""
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit).crossJoin(total).orderBy(*order)  # total is one row; the page is sorted anew


def by_created(descending: bool, key: str = "scan_id") -> list[Column]:
    """Newest or oldest first; the id falls in both."""
    return [F.desc_nulls_last("created_at") if descending else F.asc_nulls_last("created_at"), F.desc(key)]


def list_scans(scans: DataFrame, projects: DataFrame, user_id, project_id=None, status=None, number: int = 1, limit: int = 10, descending: bool = True) -> DataFrame:
    owned = matching(projects, user_id=user_id).select("project_id")
    rows = matching(scans, project_id=project_id, status=status).join(owned, "project_id")
    return page(rows.select("scan_id", "project_id", "status", "started_at", "finished_at", "created_at", "updated_at"), number, limit, *by_created(descending))


def with_owner(scans: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    named = projects.select("project_id", "user_id", F.col("name").alias("project_name"))
    people = users.select(F.col("id").alias("user_id"), "username", "email")
    return scans.join(named, "project_id").join(people, "user_id")


def list_admin_scans(scans: DataFrame, projects: DataFrame, users: DataFrame, status=None, project_id=None, user_id=None, number: int = 1, limit: int = 10, descending: bool = True) -> DataFrame:
    rows = matching(with_owner(matching(scans, status=status, project_id=project_id), projects, users), user_id=user_id)
    rows = rows.select("scan_id", "status", "error_message", "created_at", "started_at", "finished_at", "project_id", "project_name", "user_id", "username", "email")
    return page(rows, number, limit, *by_created(descending))


def failed_scans(scans: DataFrame, projects: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    """The failed scans that ended last."""
    ended = F.coalesce("finished_at", "updated_at", "created_at")
    rows = with_owner(matching(scans, status="failed"), projects, users).withColumn("ended_at", ended)
    return rows.select("scan_id", "error_message", "ended_at", "project_id", "project_name", "user_id", "username").orderBy(F.desc_nulls_last("ended_at"), F.desc("scan_id")).limit(limit)


def timeline_days(events: DataFrame, ts: str, as_of: date, days: int = 14) -> DataFrame:
    """Rows for each of the last days to as_of, days without rows as 0."""
    spine = events.sparkSession.range(days).select(F.date_add(F.lit(as_of), (F.col("id") - (days - 1)).cast("int")).alias("date"))
    start, stop = F.date_add(F.lit(as_of), -(days - 1)), F.date_add(F.lit(as_of), 1)
    counts = events.where((F.col(ts) >= start.cast("timestamp")) & (F.col(ts) < stop.cast("timestamp"))).groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))
    return spine.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def timeline_months(events: DataFrame, ts: str, as_of: date, months: int = 15) -> DataFrame:
    """Rows for each month to that of as_of, months without rows as 0."""
    this = F.trunc(F.lit(as_of), "month")
    spine = events.sparkSession.range(months).select(F.add_months(this, (F.col("id") - (months - 1)).cast("int")).alias("date"))
    inside = (F.col(ts) >= F.add_months(this, -(months - 1)).cast("timestamp")) & (F.col(ts) < F.add_months(this, 1).cast("timestamp"))
    counts = events.where(inside).groupBy(F.trunc(ts, "month").alias("date")).agg(F.count("*").alias("n"))
    return spine.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def status_distribution(scans: DataFrame) -> DataFrame:
    """Scans in each state, states without scans as 0."""
    states = scans.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return states.join(scans.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def status_counts(scans: DataFrame, projects: DataFrame, user_id, project_id=None) -> DataFrame:
    """One row; total counts all states, cancelled ones too."""
    owned = matching(projects, user_id=user_id).select("project_id")
    rows = matching(scans, project_id=project_id).join(owned, "project_id")
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "pending", "failed", "running")))


def owned_scans(scans: DataFrame, projects: DataFrame, project_id, user_id=None) -> DataFrame:
    owned = matching(projects, project_id=project_id, user_id=user_id).select("project_id")
    return matching(scans, project_id=project_id).join(owned, "project_id", "left_semi")


def latest_finished(scans: DataFrame, statuses=("succeeded",), limit: int = HISTORY) -> DataFrame:
    done = scans.where(F.col("status").isin(*statuses) & F.col("finished_at").isNotNull())
    return done.orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(limit)


def risk_trend(scans: DataFrame, projects: DataFrame, files: DataFrame, project_id, user_id=None, limit: int = HISTORY) -> DataFrame:
    """Mean score in per cent of the last succeeded scans; those without files as 0."""
    last = latest_finished(owned_scans(scans, projects, project_id, user_id), limit=limit).select("scan_id", "finished_at")
    means = last.join(files.select("scan_id", "refactor_score"), "scan_id", "left").groupBy("scan_id", "finished_at").agg(F.avg("refactor_score").alias("mean"))
    return means.select("scan_id", "finished_at", percent(F.col("mean")).alias("average_score")).orderBy("finished_at", "scan_id")


def duration_trend(scans: DataFrame, projects: DataFrame, project_id, user_id=None, limit: int = HISTORY) -> DataFrame:
    """Seconds of the last finished scans, reversed ones as 0."""
    last = latest_finished(owned_scans(scans, projects, project_id, user_id).where("started_at is not null"), ("succeeded", "failed"), limit)
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return last.select("scan_id", "status", "finished_at", F.round(F.when(seconds > 0, seconds).otherwise(0.0), 2).alias("duration_seconds"))


def apply_status(scans: DataFrame, changes: DataFrame) -> DataFrame:
    """Guarded transitions: changes(scan_id, status, at, error_message) to scans, one change a scan.

    pending -> running; running -> succeeded; pending or running -> failed or cancelled; others are left out.
    started_at is set once, and only failed scans keep an error message.
    """
    new = changes.select("scan_id", F.col("status").alias("to"), "at", F.col("error_message").alias("why"))
    old = F.col("status")
    allowed = ((F.col("to") == "running") & (old == "pending")) | ((F.col("to") == "succeeded") & (old == "running")) | (F.col("to").isin("failed", "cancelled") & old.isin("pending", "running"))
    go = F.coalesce(allowed, F.lit(False))
    return scans.join(new, "scan_id", "left").select(
        *(
            {
                "status": F.when(go, F.col("to")).otherwise(old), "started_at": F.when(go & (F.col("to") == "running"), F.coalesce("started_at", "at")).otherwise(F.col("started_at")),
                "finished_at": F.when(go & (F.col("to") != "running"), F.col("at")).otherwise(F.col("finished_at")), "updated_at": F.when(go, F.col("at")).otherwise(F.col("updated_at")),
                "error_message": F.when(go, F.when(F.col("to") == "failed", F.col("why"))).otherwise(F.col("error_message")),
            }.get(c, F.col(c)).alias(c)
            for c in scans.columns
        )
    )


def page_counts(total: int, number: int, limit: int) -> dict[str, int | bool]:
    pages = -(-total // limit)
    return {"total_pages": pages, "has_next": number < pages, "has_prev": number > 1}


def last_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
