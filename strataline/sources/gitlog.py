"""Commit logs of local repositories as a Spark data source, cut into ranges of commits.

`spark.read.format("commit_log").option("repos", json).option("commits", n).load()` gives one row for each commit and
file, in the paths of that time. A repository of any size is many tasks: each reads `commits` entries of git's own
newest-first order, and `pos` is an entry's place in that order. Commits carry whole seconds only, so `pos` is what
tells which of two came first. Renames are rows of their own (`before` is the older path); `todays_paths` follows
them over the whole log with windows and joins, so no task has to read the log from its start.
"""

from __future__ import annotations

import json
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..shipping import ship
from .storage import cut

GIT_SECONDS, ERROR_TAIL = 120, 500
#: Commits that a task reads.
RANGE = 1000
RAW = "repo string, pos long, hash string, email string, ts timestamp, subject string, path string, before string, added string, deleted string, error string"


def git(repo: str, *args: str, asked: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=asked, capture_output=True, timeout=GIT_SECONDS, check=True).stdout


def failure(e: Exception) -> str:
    said = getattr(e, "stderr", None) or str(e)
    return (said.decode(errors="replace") if isinstance(said, bytes) else said)[-ERROR_TAIL:]


def numstat(body: str) -> list[tuple[str, str, str, str | None]]:
    """added, deleted, path and the path before a rename, of the NUL-ended lines of one commit."""
    out, fields = [], iter(body.split("\0"))
    for line in fields:
        if line.strip():
            added, deleted, path = line.lstrip("\n").split("\t", 2)
            before = None if path else next(fields)
            out.append((added, deleted, path or next(fields), before))
    return out


class Range(InputPartition):
    def __init__(self, repo: str, tip: str, skip: int, most: int):
        self.repo, self.tip, self.skip, self.most = repo, tip, skip, most


class CommitLogReader(DataSourceReader):
    def __init__(self, repos: list[str], commits: int):
        self.repos, self.commits = repos, commits

    def partitions(self) -> list[Range]:
        """Ranges of one tip for each repository, so that commits made meanwhile move nothing; a repository that cannot be read is a range that says so."""
        out = []
        for repo in self.repos:
            try:
                tip = git(repo, "rev-parse", "--verify", "HEAD").decode().strip()
                count = int(git(repo, "rev-list", "--count", "--no-merges", tip))
                out += [Range(repo, tip, at, self.commits) for at in range(0, count, self.commits)]
            except (OSError, subprocess.SubprocessError) as e:
                out.append(Range(repo, "", 0, 0))
                out[-1].error = failure(e)
        return out

    def read(self, partition: Range):
        blank = (None,) * 9
        if not partition.tip:
            yield (partition.repo, *blank, partition.error)
            return
        try:
            said = git(partition.repo, "log", "--no-merges", "--numstat", "-M", "-z", f"--skip={partition.skip}", f"--max-count={partition.most}", "--format=%x01%H%x02%ae%x02%at%x02%s%x03", partition.tip)
        except (OSError, subprocess.SubprocessError) as e:
            yield (partition.repo, *blank, failure(e))
            return
        for k, entry in enumerate(said.decode(errors="replace").split("\x01")[1:]):
            head, _, body = entry.partition("\x03")
            hash_, email, at, subject = head.split("\x02", 3)
            when = datetime.fromtimestamp(int(at), timezone.utc)
            for added, deleted, path, before in numstat(body):
                yield (partition.repo, partition.skip + k, hash_, email, when, subject, path, before, added, deleted, None)


class CommitLog(DataSource):
    """Options: repos, a JSON list of folders that all executors see; commits, how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> CommitLogReader:
        return CommitLogReader(json.loads(self.options["repos"]), int(self.options.get("commits", RANGE)))


def raw_log(spark: SparkSession, repos: list[str], commits: int = RANGE) -> DataFrame:
    ship(spark).dataSource.register(CommitLog)
    return spark.read.format("commit_log").option("repos", json.dumps(repos)).option("commits", commits).load()


def todays_paths(log: DataFrame) -> DataFrame:
    """log(repo, pos, path, before, ...) with `path` the name that the file has today and `source_path` the one it had then.

    A rename at a place gives the older name's earlier commits to the newer name, and ends what the newer name meant
    before: an older file of that name is another one. For each row the nearest newer event of its name decides: the
    name was given away (then it is what the receiver is called today) or taken over (then it keeps its own). Where
    one commit does both, the name was given away. Chains of renames double their stride each round.
    """
    renames = cut(log.where("before is not null").select("repo", "pos", F.col("path").alias("after"), "before").distinct())
    taken = renames.select("repo", "pos", F.col("after").alias("name"), F.lit(0).alias("given"), F.lit(None).cast("string").alias("to"))
    given = renames.select("repo", "pos", F.col("before").alias("name"), F.lit(1).alias("given"), F.col("after").alias("to"))
    events = taken.unionByName(given)

    def nearest(rows: DataFrame, name: str) -> DataFrame:
        """rows(repo, pos, <name>, ...) with the event of a newer commit that decides on the name: (pos, to), null where it was taken over or nothing happened."""
        held = [c for c in rows.columns if c not in ("repo", "pos", name)]
        asked = rows.select("repo", "pos", F.col(name).alias("name"), F.lit(None).cast("int").alias("given"), F.lit(None).cast("string").alias("to"), F.struct(*held).alias("held") if held else F.lit(True).alias("held"))
        both = asked.unionByName(events.withColumn("held", F.lit(None).cast(asked.schema["held"].dataType)))
        newer = Window.partitionBy("repo", "name").orderBy("pos", F.coalesce("given", F.lit(-1)), F.col("to")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a row sorts before the events of its own commit, so what it sees is newer
        event = F.last(F.when(F.col("given").isNotNull(), F.struct("given", "pos", "to")), ignorenulls=True).over(newer)
        found = both.withColumn("event", event).where("given is null")
        step = F.when(F.col("event.given") == 1, F.struct(F.col("event.pos").alias("pos"), F.col("event.to").alias("to")))
        return found.select("repo", "pos", F.col("name").alias(name), *(F.col(f"held.{c}").alias(c) for c in held), step.alias("step"))

    # what each rename's receiver is called today: the end of the chain of renames after it
    chain = cut(nearest(renames, "after").select("repo", "pos", F.col("after").alias("to"), F.col("step.pos").alias("next_pos"), F.col("step.to").alias("next_to")))
    done = chain.where("next_pos is null").select("repo", "pos", "to", F.col("to").alias("today"))
    open_ = chain.where("next_pos is not null")
    while not open_.isEmpty():
        ends = done.select("repo", F.col("pos").alias("next_pos"), F.col("to").alias("next_to"), "today")
        hops = open_.select("repo", F.col("pos").alias("next_pos"), F.col("to").alias("next_to"), F.col("next_pos").alias("far_pos"), F.col("next_to").alias("far_to"))
        moved = open_.join(ends, ["repo", "next_pos", "next_to"], "left").join(hops, ["repo", "next_pos", "next_to"], "left")
        moved = cut(moved.select("repo", "pos", "to", "today", F.coalesce("far_pos", "next_pos").alias("next_pos"), F.coalesce("far_to", "next_to").alias("next_to")))
        done = cut(done.unionByName(moved.where("today is not null").select("repo", "pos", "to", "today")))
        open_ = moved.where("today is null").drop("today")
    last = done.select("repo", F.col("pos").alias("at"), F.col("to").alias("into"), "today")
    rows = nearest(log.where("error is null"), "path")
    rows = rows.withColumn("at", F.col("step.pos")).withColumn("into", F.col("step.to")).drop("step").join(last, ["repo", "at", "into"], "left")
    named = rows.withColumn("source_path", F.col("path")).withColumn("path", F.coalesce("today", "path")).drop("today", "at", "into")
    failed = log.where("error is not null").withColumn("source_path", F.col("path"))
    return named.unionByName(failed).drop("before")
