"""Change-history metrics from commit tables: commits(hash, email, ts, subject, pos) and commit_files(hash, path, added, deleted), added and deleted as text.

pos is a commit's place in the log, counted from the newest; times are whole seconds and do not tell the order of
commits of one second. Tables without pos fall back on time and hash.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from ..sources.storage import cut

#: Words that mark a repair, anywhere in a lower-cased subject (fixed values).
BUG_WORDS = ("fix", "bug", "issue", "patch", "hotfix", "repair", "correct", "defect")
#: Changes looked at for co-change, and files above which a commit is left out.
CO_CHANGE_COMMITS, BULK_FILES, RECENT_MONTHS, SAMPLE = 100, 25, 3, 10


def follow_renames(commit_files: DataFrame, renames: DataFrame) -> DataFrame:
    """commit_files under today's paths: renames(old_path, new_path) with chains already resolved."""
    to = renames.select(F.col("old_path").alias("path"), "new_path")
    return commit_files.join(to, "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")


def changes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row for each path and commit, `age` counting from the oldest, `recency` from the newest."""
    lines = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))  # noqa: E731  "-" of binary files counts 0
    rows = commit_files.groupBy("path", "hash").agg(F.sum(lines("added") + lines("deleted")).alias("churn")).join(commits, "hash")
    w = Window.partitionBy("path")
    newest = [F.col("pos"), F.col("hash")] if "pos" in commits.columns else [F.desc("ts"), F.desc("hash")]
    oldest = [F.desc("pos"), F.desc("hash")] if "pos" in commits.columns else [F.col("ts"), F.col("hash")]
    return rows.withColumn("age", F.row_number().over(w.orderBy(*oldest))).withColumn("recency", F.row_number().over(w.orderBy(*newest)))


def co_changes(commits: DataFrame, commit_files: DataFrame, newest: int = CO_CHANGE_COMMITS, bulk: int = BULK_FILES, made: DataFrame | None = None) -> DataFrame:
    """path and peer of each pair changed together in the newest changes of path, its creation and bulk commits aside; made: the changes, if there already."""
    looked = (changes(commits, commit_files) if made is None else made).where((F.col("age") > 1) & (F.col("recency") <= newest)).select("path", "hash")
    touched = commit_files.select("hash", "path").distinct()
    sizes = touched.groupBy("hash").agg(F.count("*").alias("files")).where(F.col("files") <= bulk).select("hash")
    peers = touched.join(sizes, "hash").select("hash", F.col("path").alias("peer"))  # at most `bulk` rows a commit
    return looked.join(peers, "hash").where("path <> peer").select("path", "peer").distinct()


def history_metrics(commits: DataFrame, commit_files: DataFrame, as_of: datetime, sizes: DataFrame | None = None, newest: int = CO_CHANGE_COMMITS, bulk: int = BULK_FILES) -> DataFrame:
    """Metrics of each path; sizes(path, lines) gives the lines that churn is held against, unknown ones count as 1."""
    rows = cut(changes(commits, commit_files))
    bug = F.lower("subject").rlike("|".join(BUG_WORDS)) & (F.col("age") > 1)
    recent = F.col("ts") >= F.add_months(F.lit(as_of).cast("timestamp").cast("date"), -RECENT_MONTHS).cast("timestamp")
    out = rows.groupBy("path").agg(
        F.countDistinct(F.trim("email")).alias("contributors_count"), F.count("*").alias("update_count"), F.count_if(recent).alias("recent_update_count"),
        F.sum("churn").alias("churn_rate"), F.count_if(bug).alias("bug_fix_commit_count"),
    )
    sized = rows.join(commit_files.select("hash", F.col("path").alias("any")).distinct().groupBy("hash").agg(F.count("*").alias("files")), "hash").where((F.col("age") > 1) & (F.col("recency") <= newest))
    looked = sized.groupBy("path").agg(F.count("*").alias("commits_analyzed"), F.count_if(F.col("files") > bulk).alias("bulk_commits_skipped"))
    peers = co_changes(commits, commit_files, newest, bulk, rows).groupBy("path").agg(F.count("*").alias("co_change_file_count"), F.sort_array(F.collect_list("peer")).alias("co_changed_files"))
    out = out.join(looked, "path", "left").join(peers, "path", "left")
    lines = F.lit(1)
    if sizes is not None:
        out, lines = out.join(sizes.select("path", "lines"), "path", "left"), F.greatest(F.lit(1), F.coalesce("lines", F.lit(1)))
    updates = F.col("update_count")
    return out.select(
        "path", "contributors_count", "update_count", "recent_update_count", F.greatest(F.lit(0), updates - F.col("recent_update_count")).cast("long").alias("historical_update_count"),
        ratio(F.col("recent_update_count"), updates).alias("recent_to_lifetime_update_ratio"), "churn_rate", ratio(F.col("churn_rate"), lines).alias("churn_to_size_ratio"), "bug_fix_commit_count",
        ratio(F.col("bug_fix_commit_count"), updates - 1).alias("bug_fix_ratio"), F.coalesce("co_change_file_count", F.lit(0)).cast("long").alias("co_change_file_count"),
        F.coalesce("commits_analyzed", F.lit(0)).cast("long").alias("commits_analyzed"), F.coalesce("bulk_commits_skipped", F.lit(0)).cast("long").alias("bulk_commits_skipped"),
        F.slice(F.coalesce("co_changed_files", F.array().cast("array<string>")), 1, SAMPLE).alias("co_changed_sample"),
    )


def complexity_growth(versions: DataFrame, complexity: str = "average_cyclomatic_complexity") -> DataFrame:
    """versions(path, ts, <complexity>): the newest value less the oldest, rounded to 3; null where one is missing."""
    ends = versions.groupBy("path").agg(F.max_by(complexity, "ts").alias("now"), F.min_by(complexity, "ts").alias("then"))
    return ends.select("path", F.round(F.col("now") - F.col("then"), 3).alias("cyclomatic_complexity_growth_rate"))
