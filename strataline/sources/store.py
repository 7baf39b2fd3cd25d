"""The result store: payloads, edges, groups and records in the form in which they are kept, and their writers."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .versions import Raced


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def file_payloads(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """paths(scan_id, path) with vectors(scan_id, path, layer, metrics map<string,double>, errors array<string>) as one map for each path; a path without vectors has empty maps, errors only where there are some."""
    last = vectors.groupBy("scan_id", "path", "layer").agg(F.max_by("metrics", F.coalesce("created_at", F.lit(0).cast("timestamp"))).alias("metrics"), F.flatten(F.collect_list("errors")).alias("errors")) if "created_at" in vectors.columns else vectors
    clean = F.transform_values("metrics", lambda _, v: finite(v))
    rows = last.select("scan_id", "path", F.struct("layer", clean.alias("m")).alias("m"), F.struct("layer", "errors").alias("e"))
    packed = rows.groupBy("scan_id", "path").agg(F.map_from_entries(F.collect_list("m")).alias("metrics"), F.map_from_entries(F.filter(F.collect_list("e"), lambda x: F.size(x["errors"]) > 0)).alias("errors"))
    decision = F.try_element_at(F.col("metrics"), F.lit("decision"))
    out = paths.select("scan_id", "path").distinct().join(packed, ["scan_id", "path"], "left")
    return out.select(
        "scan_id", "path", F.coalesce("metrics", F.create_map().cast("map<string,map<string,double>>")).alias("metrics"), F.coalesce("errors", F.create_map().cast("map<string,array<string>>")).alias("errors"),
        F.round(F.try_element_at(decision, F.lit("refactor_score")), 5).cast("decimal(6,5)").alias("refactor_score"),
    )


def dependency_edges(files: DataFrame, raw: DataFrame) -> DataFrame:
    """raw(scan_id, pair array<string>): distinct edges between two known files; others, loops and malformed pairs go."""
    pairs = raw.where((F.size("pair") == 2)).select("scan_id", F.col("pair")[0].alias("s"), F.col("pair")[1].alias("t")).where("s <> t")
    named = files.select("scan_id", "path", "file_id")
    out = pairs.join(named.toDF("scan_id", "s", "source_file_id"), ["scan_id", "s"]).join(named.toDF("scan_id", "t", "target_file_id"), ["scan_id", "t"])
    return out.select("scan_id", "source_file_id", "target_file_id").distinct()


def cycle_members(files: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(scan_id, group_id, nodes): known members, in groups of two or more, with the group's size."""
    nodes = groups.select("scan_id", "group_id", F.explode("nodes").alias("path")).distinct()
    known = nodes.join(files.select("scan_id", "path", "file_id"), ["scan_id", "path"])
    sizes = known.groupBy("scan_id", "group_id").agg(F.count("*").alias("size")).where("size > 1")
    return known.join(sizes, ["scan_id", "group_id"]).select("scan_id", "group_id", "file_id", "size")


def co_change_edges(files: DataFrame, raw: DataFrame) -> DataFrame:
    """raw(scan_id, path, peer): each pair of known files once, the lesser id first."""
    named = files.select("scan_id", "path", "file_id")
    both = raw.join(named, ["scan_id", "path"]).join(named.toDF("scan_id", "peer", "peer_id"), ["scan_id", "peer"]).where("file_id <> peer_id")
    return both.select("scan_id", F.least("file_id", "peer_id").alias("file_id_a"), F.greatest("file_id", "peer_id").alias("file_id_b")).distinct()


def overwrite_scans(df: DataFrame, path: str) -> None:
    """Replace the scans that df has, and only those."""
    df.write.mode("overwrite").partitionBy("scan_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def best_effort(write, *args) -> bool:
    """A sink whose failure to write is logged and does not stop the pipeline; faults of the caller still raise."""
    try:
        write(*args)
    except (PySparkException, Py4JJavaError, OSError, Raced):
        logging.getLogger(__name__).exception("sink failed")
        return False
    return True


def latest_rows(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table that a log of upserts and deletes (deleted boolean) stands for: last write wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not deleted").drop("_n", "deleted")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascading delete of one level."""
    return rows.join(gone.select(key), key, "left_anti")


def missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What a cache still has to make."""
    return wanted.join(cached.select(*keys), keys, "left_anti")
