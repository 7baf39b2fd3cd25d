"""Queries over the files of scans: files(file_id, scan_id, file_path, refactor_score, priority_band, created_at), edges(scan_id, source_file_id, target_file_id), members(group_id, scan_id, file_id), co_changes(scan_id, file_id_a, file_id_b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percent
from ..functions.paths import directory, language
from .scans import HISTORY, latest_finished, matching, owned_scans

BANDS = ("critical", "high", "medium", "low")
RISKY = ("critical", "high", "medium")


def priority_distribution(scans: DataFrame, projects: DataFrame, files: DataFrame, project_id, user_id=None, limit: int = HISTORY) -> DataFrame:
    """Files in each band of the last succeeded scans."""
    last = latest_finished(owned_scans(scans, projects, project_id, user_id), limit=limit).select("scan_id", "finished_at")
    band = F.lower(F.coalesce("priority_band", F.lit("unknown")))
    rows = last.join(files.select("scan_id", band.alias("band")), "scan_id", "left").groupBy("scan_id", "finished_at")
    return rows.agg(*(F.count_if(F.col("band") == b).alias(b) for b in BANDS))


def files_analysed(scans: DataFrame, projects: DataFrame, files: DataFrame, project_id, user_id=None, limit: int = HISTORY) -> DataFrame:
    last = latest_finished(owned_scans(scans, projects, project_id, user_id), limit=limit).select("scan_id", "finished_at")
    return last.join(files.select("scan_id", "file_id"), "scan_id", "left").groupBy("scan_id", "finished_at").agg(F.count("file_id").alias("files_analyzed"))


def accessible(scans: DataFrame, projects: DataFrame, scan_id, user_id) -> DataFrame:
    """The scan's row if it succeeded and is the user's, else none."""
    owned = matching(projects, user_id=user_id).select("project_id")
    return matching(scans, scan_id=scan_id, status="succeeded").join(owned, "project_id", "left_semi")


def list_scan_files(scans: DataFrame, projects: DataFrame, files: DataFrame, scan_id, user_id) -> DataFrame:
    own = accessible(scans, projects, scan_id, user_id).select("scan_id")
    return matching(files, scan_id=scan_id).join(own, "scan_id", "left_semi").select("file_id", "file_path", "priority_band")


def dependency_edges(edges: DataFrame, files: DataFrame, scan_id=None) -> DataFrame:
    """Edges with both paths."""
    named = files.select("file_id", "file_path")
    s, t = named.toDF("source_file_id", "source_path"), named.toDF("target_file_id", "target_path")
    return matching(edges, scan_id=scan_id).join(s, "source_file_id").join(t, "target_file_id").select("scan_id", "source_file_id", "target_file_id", "source_path", "target_path")


def circular_dependencies(members: DataFrame, files: DataFrame, scan_id=None) -> DataFrame:
    """Groups with their members in order of path; groups in order of their members' paths."""
    rows = matching(members, scan_id=scan_id).join(files.select("file_id", "file_path", "priority_band"), "file_id")
    listed = F.sort_array(F.collect_list(F.struct("file_path", "file_id", "priority_band")))
    return rows.groupBy("scan_id", "group_id").agg(F.count("*").alias("size"), listed.alias("members")).orderBy("scan_id", F.transform("members", lambda m: m["file_path"]), "group_id")


def neighbours(edges: DataFrame, files: DataFrame, file_id) -> DataFrame:
    """Files that a file depends on (outgoing) or that depend on it (incoming)."""
    touching = edges.where((F.col("source_file_id") == file_id) | (F.col("target_file_id") == file_id))
    out = F.col("source_file_id") == file_id
    rows = touching.select(F.when(out, F.col("target_file_id")).otherwise(F.col("source_file_id")).alias("file_id"), F.when(out, "outgoing").otherwise("incoming").alias("direction"))
    return rows.join(files.select("file_id", "file_path", "priority_band"), "file_id")


def co_changed(co_changes: DataFrame, files: DataFrame, file_id) -> DataFrame:
    touching = co_changes.where((F.col("file_id_a") == file_id) | (F.col("file_id_b") == file_id))
    peer = F.when(F.col("file_id_a") == file_id, F.col("file_id_b")).otherwise(F.col("file_id_a"))
    return touching.select(peer.alias("file_id")).join(files.select("file_id", "file_path", "priority_band"), "file_id")


def file_details(scans: DataFrame, projects: DataFrame, files: DataFrame, file_id, user_id) -> DataFrame:
    own = projects.where(F.col("user_id") == user_id).select("project_id")
    done = matching(scans, status="succeeded").join(own, "project_id", "left_semi").select("scan_id", F.col("finished_at").alias("last_scan_at"))
    rows = matching(files, file_id=file_id).join(done, "scan_id")
    return rows.select("file_id", "scan_id", "file_path", language(F.col("file_path")).alias("language"), F.col("refactor_score").cast("double").alias("refactor_score"), "priority_band", "created_at", "last_scan_at")


def resolve_samples(samples: DataFrame, files: DataFrame) -> DataFrame:
    """samples(file_id, scan_id, peers array<string>): peers as references to files of the scan, unknown paths with a null id."""
    peers = samples.select("file_id", "scan_id", F.posexplode("peers").alias("n", "file_path"))
    known = files.select(F.col("file_id").alias("peer_id"), "scan_id", "file_path", "priority_band")
    rows = peers.join(known, ["scan_id", "file_path"], "left")
    return rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("n", "file_path", "peer_id", "priority_band"))).alias("matches"))


#: Samples of matching blocks in a file's metadata, in the order in which they are listed.
SAMPLES = {"syntax": "$.duplication_analysis.syntax_duplicate_blocks_sample", "semantic": "$.duplication_analysis.semantic_duplicate_blocks_sample"}
MATCH = "struct<kind: string, start_line: int, end_line: int, max_similarity: double, matched_files: array<string>>"


def duplicate_matches(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The matches in the metadata (JSON) of rows(file_id, scan_id, metadata), each with its matched files as references.

    A row for each item of the samples: match_type, place (in its sample, from 0), kind, lines, max_similarity and
    matched_files, references to files of the scan in the order of the item. Paths that the scan does not have are left
    out, items that are no objects too, and metadata that are null, no JSON or of another form have no matches.
    """

    def items(kind: str, path: str):
        listed_ = F.coalesce(F.from_json(F.get_json_object("metadata", path), "array<string>"), F.array().cast("array<string>"))
        return F.transform(listed_, lambda item, at: F.struct(F.lit(list(SAMPLES).index(kind)).alias("sample"), at.alias("place"), F.lit(kind).alias("match_type"), F.when(item.startswith("{"), item).alias("item")))

    every = rows.select("file_id", "scan_id", F.explode(F.concat(*(items(k, p) for k, p in SAMPLES.items()))).alias("m")).select("file_id", "scan_id", "m.*").where("item is not null")
    parsed = every.withColumn("item", F.from_json("item", MATCH)).select("file_id", "scan_id", "sample", "place", "match_type", "item.*")
    asked = parsed.select("file_id", "scan_id", "sample", "place", F.posexplode("matched_files").alias("n", "file_path"))
    known = files.select(F.col("file_id").alias("peer_id"), "scan_id", "file_path", "priority_band")
    found = asked.join(known, ["scan_id", "file_path"]).groupBy("file_id", "sample", "place").agg(F.sort_array(F.collect_list(F.struct("n", "file_path", "peer_id", "priority_band"))).alias("found"))
    both = parsed.drop("matched_files").join(found, ["file_id", "sample", "place"], "left")
    references = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda m: F.struct(m["peer_id"].alias("file_id"), m["file_path"].alias("file_path"), m["priority_band"].alias("priority_band")))
    return both.select("file_id", "match_type", "place", "kind", "start_line", "end_line", "max_similarity", references.alias("matched_files"))


def file_report(scans: DataFrame, projects: DataFrame, files: DataFrame, edges: DataFrame, members: DataFrame, co_changes: DataFrame, file_id, user_id) -> DataFrame:
    """file_details of one file, with its metadata and, as arrays of references ordered by path, what it depends on, what depends on it, the other members of its cycle and the files changed with it; and its duplicate matches."""

    def listed_(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.sort_array(F.collect_set(F.struct("file_path", "file_id", "priority_band"))).alias(name))

    near = neighbours(edges, files, file_id)
    own = members.where(F.col("file_id") == file_id).select("scan_id", "group_id")
    cycle = members.join(own, ["scan_id", "group_id"], "left_semi").where(F.col("file_id") != file_id).select("file_id").join(files.select("file_id", "file_path", "priority_band"), "file_id")
    metadata = matching(files, file_id=file_id).select("file_id", "scan_id", "metadata")
    matches = duplicate_matches(metadata, files).agg(F.sort_array(F.collect_list(F.struct(F.col("match_type") != "syntax", "place", F.struct("match_type", "kind", "start_line", "end_line", "max_similarity", "matched_files").alias("match")))).alias("m"))
    out = file_details(scans, projects, files, file_id, user_id).join(metadata.select("file_id", "metadata"), "file_id")
    for part in (listed_(near.where("direction = 'outgoing'"), "depends_on"), listed_(near.where("direction = 'incoming'"), "dependents"), listed_(cycle, "cycle"), listed_(co_changed(co_changes, files, file_id), "changed_with"), matches.select(F.col("m.match").alias("duplicate_matches"))):
        out = out.crossJoin(part)  # one row each
    return out


def overview_trend(scans: DataFrame, files: DataFrame, scan_id, previous: int = 3) -> DataFrame:
    """The scan and the succeeded ones of its project just before it, with mean scores."""
    target = F.broadcast(matching(scans, scan_id=scan_id).select("project_id", F.col("finished_at").alias("at"), F.col("scan_id").alias("target")))  # one row
    rows = matching(scans, status="succeeded").where("finished_at is not null").join(target, "project_id")
    before = (F.col("finished_at") < F.col("at")) | ((F.col("finished_at") == F.col("at")) & (F.col("scan_id") <= F.col("target")))
    last = rows.where(before).orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(previous + 1).select("scan_id", "finished_at")
    means = last.join(files.select("scan_id", "refactor_score"), "scan_id", "left").groupBy("scan_id", "finished_at").agg(F.avg("refactor_score").alias("mean"))
    return means.select("scan_id", "finished_at", percent(F.col("mean")).alias("average_score"))


def scan_summary(files: DataFrame, scan_id) -> DataFrame:
    """One row: all files, unknown bands too, and those of each band."""
    band = F.lower(F.coalesce("priority_band", F.lit("unknown")))
    return matching(files, scan_id=scan_id).agg(F.count("*").alias("total_files"), *(F.count_if(band == b).alias(b) for b in BANDS))


def top_files(files: DataFrame, scan_id, limit: int = 5) -> DataFrame:
    rows = matching(files, scan_id=scan_id).orderBy(F.desc_nulls_last("refactor_score"), F.asc("file_path")).limit(limit)
    return rows.select("file_id", "file_path", percent(F.col("refactor_score")).alias("risk_score"), "priority_band")


def risk_by_directory(files: DataFrame, scan_id=None, limit: int = 5) -> DataFrame:
    """The folders with most files of the three higher bands."""
    band = F.lower(F.coalesce("priority_band", F.lit("unknown")))
    rows = matching(files, scan_id=scan_id).groupBy(directory(F.col("file_path")).alias("directory"))
    out = rows.agg(F.count_if(band.isin(*RISKY)).alias("risky_file_count"), *(F.count_if(band == b).alias(b) for b in BANDS))
    return out.orderBy(F.desc("risky_file_count"), F.asc("directory")).limit(limit)


def directory_insight(files: DataFrame, scan_id=None, limit: int = 5, reasons: str | None = None) -> DataFrame:
    """Evidence on the folders with most critical and high files: counts, mean score, three best-placed files and, of a column of reason arrays, the three most frequent."""
    band = F.lower(F.coalesce("priority_band", F.lit("unknown")))
    rows = matching(files, scan_id=scan_id).withColumn("path", directory(F.col("file_path"))).withColumn("score", percent(F.col("refactor_score"))).withColumn("band", band)
    placed = rows.select("path", "file_path", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), F.asc("file_path"))).alias("n")).where("n <= 3")  # a group limit before the shuffle
    best = placed.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "file_path"))), lambda s: s["file_path"]).alias("top_files"))
    counts = rows.groupBy("path").agg(F.count_if(F.col("band") == "critical").alias("critical_files"), F.count_if(F.col("band") == "high").alias("high_files"), F.round(F.avg("score"), 2).alias("average_score"))
    out = counts.join(best, "path")
    if reasons:
        said = rows.select("path", "file_path", F.posexplode(reasons).alias("n", "reason")).groupBy("path", "reason").agg(F.count("*").alias("c"), F.min(F.struct("file_path", "n")).alias("first"))
        place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("c"), "first", "reason"))
        ranked = said.select("path", "reason", place.alias("n")).where("n <= 3")  # a group limit before the shuffle
        listed = ranked.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "reason"))), lambda s: s["reason"]).alias("top_risk_reasons"))
        out = out.join(listed, "path", "left")
    return out.orderBy(F.desc(F.col("critical_files") + F.col("high_files")), F.desc("average_score"), F.asc("path")).limit(limit)
