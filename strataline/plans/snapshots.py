"""Raw layer records (scan_id, layer, file_path, metrics, errors, created_at), the refactor queue and their reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import matching

#: Order of the layers (fixed values); others come last.
LAYER_ORDER = {"static": 0, "history": 1, "duplication": 2, "architecture": 3, "decision": 4}
OTHER_LAYER = 100
QUEUE_ORDER = ("todo", "in_progress", "done")


def runs(records: DataFrame) -> DataFrame:
    """Scans with the number of their records and files and their latest time, newest first."""
    rows = records.where("scan_id is not null").groupBy("scan_id")
    out = rows.agg(F.count("*").alias("vector_count"), F.countDistinct("file_path").alias("file_count"), F.max("created_at").alias("captured_at"))
    return out.orderBy(F.desc("captured_at"), F.desc("scan_id"))


def latest_run(records: DataFrame) -> DataFrame:
    return records.where("scan_id is not null").agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("scan_id"))


def layer_rank(layer):
    table = F.create_map(*(F.lit(x) for pair in LAYER_ORDER.items() for x in pair))
    return F.coalesce(F.try_element_at(table, layer), F.lit(OTHER_LAYER))


def snapshot_files(records: DataFrame, scan_id=None) -> DataFrame:
    """Files with their layers in order; records without a file are the codebase's."""
    entry = F.struct(layer_rank(F.col("layer")).alias("rank"), "layer", "created_at", "metrics")
    rows = matching(records, scan_id=scan_id).groupBy("scan_id", "file_path").agg(F.sort_array(F.collect_list(entry)).alias("layers"))
    return rows.orderBy("scan_id", F.asc_nulls_last("file_path"))


def distinct_cycles(cycles: DataFrame) -> DataFrame:
    """cycles(layer, file_path, nodes, edges): one of those with equal layer, nodes and edges, the first by path."""
    keyed = cycles.withColumn("nodes", F.sort_array("nodes")).withColumn("edges", F.sort_array("edges"))
    w = Window.partitionBy("layer", "nodes", "edges").orderBy(F.asc_nulls_last("file_path"))
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def queue_positions(items: DataFrame) -> DataFrame:
    """Positions from 0 without gaps in each project and state."""
    w = Window.partitionBy("project_id", "status").orderBy("position", "item_id")
    return items.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def queue_move(items: DataFrame, item_id, status: str, position: int) -> DataFrame:
    """The item in its new state and place, all others closing up; a place beyond the end is the end."""
    moved = F.col("item_id") == item_id
    rest = items.withColumn("status", F.when(moved, F.lit(status)).otherwise(F.col("status")))
    others = Window.partitionBy("project_id", "status").orderBy(F.when(moved, F.lit(1)).otherwise(0), "position", "item_id")
    rest = rest.withColumn("position", F.when(moved, F.col("position")).otherwise(F.row_number().over(others) - 1)).withColumn("place", F.when(moved, F.lit(position - 0.5)).otherwise(F.col("position").cast("double")))
    w = Window.partitionBy("project_id", "status").orderBy("place", "item_id")
    return rest.withColumn("position", (F.row_number().over(w) - 1).cast("int")).drop("place")


def next_position(items: DataFrame, project_id, status: str) -> DataFrame:
    return matching(items, project_id=project_id, status=status).agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).cast("int").alias("position"))


def queue(items: DataFrame, project_id) -> DataFrame:
    """A project's items by state, then place."""
    rank = F.array_position(F.array(*map(F.lit, QUEUE_ORDER)), F.col("status"))
    return matching(items, project_id=project_id).orderBy(F.when(rank == 0, len(QUEUE_ORDER) + 1).otherwise(rank), "position", "item_id")
