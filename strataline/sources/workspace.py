"""Reading source trees and commit logs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical, is_source
from ..shipping import ship
from . import gitlog
from .storage import cut


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), source and error of the *.py files below root; files that are no UTF-8 have an error and no source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    scheme_less = re.sub("^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    relative = F.when(full.startswith(scheme_less), F.substring(full, len(scheme_less) + 1, 1 << 30)).otherwise(full)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.select(canonical(F.regexp_replace(relative, "^/", "")).alias("path"), text.alias("source"))
    return out.where(is_source(F.col("path"))).withColumn("error", F.when(F.col("source").isNull(), "Failed to read file: not UTF-8"))


def git_sources(repo: str, wanted: list[tuple[str, str]]) -> list[str | None]:
    """The texts of (hash, path), null where git has none or it is no UTF-8."""
    asked = "".join(f"{h}:{p}\n" for h, p in wanted).encode()
    done = gitlog.git(repo, "cat-file", "--batch", asked=asked)
    out, at = [], 0
    for _ in wanted:
        end = done.index(b"\n", at)
        head = done[at:end].split(b" ")
        at = end + 1
        if head[-1].isdigit() and b"blob" in head:
            body = done[at : at + int(head[-1])]
            at += len(body) + 1
            try:
                out.append(body.decode())
                continue
            except UnicodeDecodeError:
                pass
        out.append(None)
    return out


def commit_log(spark: SparkSession, repos: list[str], commits: int = gitlog.RANGE) -> DataFrame:
    """One row for each commit and file of local repositories that the executors see, under today's paths, with the commit's place `pos` in the log, newest first; an error row for a repository that cannot be read."""
    return cut(gitlog.todays_paths(cut(gitlog.raw_log(spark, repos, commits))))


def first_versions(log: DataFrame) -> DataFrame:
    """repo, path, ts and source of the oldest commit of each *.py path of a log; a batch of rows asks git once for each repository in it."""
    ship(log.sparkSession)
    first = log.where("error is null and path like '%.py'").groupBy("repo", "path").agg(F.max_by(F.struct("hash", "source_path", "ts"), "pos").alias("v"))

    def read(frames):
        for frame in frames:
            for repo, rows in frame.groupby("repo"):
                out = rows[["repo", "path", "ts"]].copy()
                out["source"] = git_sources(repo, list(zip(rows["hash"], rows["source_path"], strict=True)))
                yield out

    return first.select("repo", "path", "v.*").mapInPandas(read, "repo string, path string, ts timestamp, source string")


def split_log(log: DataFrame, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """commits and commit_files of one repository's log; repo: which one, where the log has several."""
    good = log.where("error is null") if repo is None else log.where((F.col("repo") == repo) & F.col("error").isNull())
    return good.select("hash", "email", "ts", "subject", "pos").distinct(), good.select("hash", "path", "added", "deleted")
