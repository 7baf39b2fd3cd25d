"""The scan: sources, a commit log and coverage to one scored row for each file, and the records and payloads that are stored."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplication, graph, history, scoring, syntax
from ..sources import gitlog, store, versions, workspace
from ..sources.storage import cut

#: Metrics of each layer.
STATIC = (*syntax.METRICS, "testing_coverage")
HISTORY = (
    "contributors_count", "update_count", "recent_update_count", "historical_update_count", "recent_to_lifetime_update_ratio", "churn_rate", "churn_to_size_ratio", "bug_fix_commit_count", "bug_fix_ratio", "cyclomatic_complexity_growth_rate",
    "co_change_file_count",
)
DUPLICATION = ("duplicate_blocks_count", "duplicate_loc_count", "duplication_group_size", "semantic_duplicate_blocks_count", "max_similarity_score", "duplicate_file_candidates_count")
ARCHITECTURE = ("fan_in", "fan_out", "instability_index", "transitive_dependents_count", "betweenness_centrality", "circular_dependency_size", "runtime_circular_dependency_size")
DECISION = ("refactor_score", "score_confidence", "complexity_score", "history_score", "duplication_score", "architecture_score")
LAYERS = {"static": STATIC, "history": HISTORY, "duplication": DUPLICATION, "architecture": ARCHITECTURE, "decision": DECISION}


def no_errors() -> Column:
    return F.array().cast("array<string>")


def layer(paths: DataFrame, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """path, the layer's metrics as doubles and <name>_errors of every path; where the layer fails, nulls and its error."""
    metrics = LAYERS[name]
    try:
        found = made()
        errors = F.col("errors") if "errors" in found.columns else no_errors()
        rows = found.select("path", *(F.col(m).cast("double").alias(m) for m in metrics), errors.alias(f"{name}_errors"))
        out = paths.select("path").join(rows, "path", "left").withColumn(f"{name}_errors", F.coalesce(f"{name}_errors", no_errors()))
        return cut(out)
    except (PySparkException, ValueError) as e:
        failed = F.array(F.lit(f"{name} failed: {str(e).strip().splitlines()[0][: gitlog.ERROR_TAIL]}"))
        return cut(paths.select("path", *(F.lit(None).cast("double").alias(m) for m in metrics), failed.alias(f"{name}_errors")))


def history_layer(paths: DataFrame, static: DataFrame, log: DataFrame | None, versions: DataFrame | None, as_of: datetime, repo: str | None = None) -> DataFrame:
    """Metrics of the log; without a repository's log every metric is unknown and the path has an error. repo: whose log it is, where there are several; errors of others do not count."""
    if log is not None and repo is not None:
        log = log.where(F.col("repo") == repo)
        versions = versions.where(F.col("repo") == repo) if versions is not None else None
    failed = log.where("error is not null").select("error").head() if log is not None else ["no repository"]
    if failed:
        raise ValueError(f"Failed to prepare git history context: {failed[0]}")
    if log.select("repo").distinct().limit(2).count() > 1:
        raise ValueError("the log has several repositories: say which one is scanned")
    commits, touched = workspace.split_log(log)
    sizes = static.select("path", F.col("lines_of_code").alias("lines"))
    made = history.history_metrics(commits, touched, as_of, sizes)
    if versions is not None:
        then = syntax.static_metrics(versions.select("path", "source")).select("path", F.col("average_cyclomatic_complexity").alias("then"))
        both = static.select("path", F.col("average_cyclomatic_complexity").alias("now")).join(then, "path")
        growth = both.select("path", F.round(F.col("now") - F.col("then"), 3).alias("cyclomatic_complexity_growth_rate"))
    else:
        growth = paths.select("path", F.lit(None).cast("double").alias("cyclomatic_complexity_growth_rate"))
    rows = paths.select("path").join(made, "path", "left").join(growth, "path", "left")
    return rows.fillna(0, [m for m in HISTORY if m != "cyclomatic_complexity_growth_rate"])


def architecture_layer(sources: DataFrame) -> DataFrame:
    nodes, edges = graph.from_source(sources.sparkSession, sources)
    return graph.architecture_metrics(cut(nodes), cut(edges)).withColumnRenamed("node", "path")


def scan_files(
    sources: DataFrame, log: DataFrame | None = None, coverage: DataFrame | None = None, as_of: datetime | None = None, versions: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = duplication.hashing_vectors,
    repo: str | None = None,
) -> DataFrame:
    """One row for each file of sources(path, source): the metrics of four layers, their errors, and the scores.

    log, versions: of workspace.commit_log and first_versions; embed: blocks to vectors (id, path, embedding), or None.
    A layer that fails leaves nulls and an error, and the others still count.
    """
    sources = cut(sources.select("path", "source"))
    paths = sources.select("path")
    static = layer(paths, "static", lambda: syntax.static_metrics(sources, coverage))

    def copies() -> DataFrame:
        parsed = cut(syntax.parsed_blocks(sources))
        blocks = cut(syntax.listed(parsed))
        return duplication.duplication_metrics(paths, blocks, cut(embed(blocks)) if embed else None).join(parsed.select("path", "errors"), "path", "left")

    layers = [
        static, layer(paths, "history", lambda: history_layer(paths, static, log, versions, as_of or datetime.now(), repo)), layer(paths, "duplication", copies), layer(paths, "architecture", lambda: architecture_layer(sources)),
    ]
    wide = cut(reduce(lambda a, b: a.join(b, "path"), layers))
    return scoring.score_files(wide)


def layer_records(scored: DataFrame, scan_id: int, created_at: datetime) -> DataFrame:
    """scan_id, path, layer, metrics, errors and created_at: the rows of all layers one below the other."""

    def one(name: str) -> DataFrame:
        metrics = F.create_map(*(x for m in LAYERS[name] for x in (F.lit(m), F.col(m).cast("double"))))
        errors = F.col("decision_errors" if name == "decision" else f"{name}_errors")
        return scored.select(F.lit(scan_id).cast("long").alias("scan_id"), "path", F.lit(name).alias("layer"), metrics.alias("metrics"), errors.alias("errors"), F.lit(created_at).cast("timestamp").alias("created_at"))

    return reduce(DataFrame.unionByName, map(one, LAYERS))


#: What a scan replaces as one, and the columns of each table.
STORED = {
    "payloads": "path string, metrics string, errors string, refactor_score decimal(6,5)", "dependencies": "src string, dst string, is_runtime boolean", "co_changes": "path string, peer string", "cycles": "node string, cycle_id string",
}


def scan_store(spark: SparkSession, folder: str) -> versions.Store:
    return versions.Store(spark, folder, "scan_id", STORED)


def store_scan(scored: DataFrame, scan_id: int, created_at: datetime, folder: str, **children: DataFrame) -> DataFrame:
    """Append the records, replace the scan's payloads and children in one commit, and give the summary of the scan.

    children: dependencies, co_changes and cycles, those that are there; tables left out are empty for this scan from
    now on. Readers see all of a scan's tables change at once (`scan_store(...).read(name)`). Records are a log of
    their own; a sink that fails is logged, and what was stored before stays.
    """
    scored = cut(scored)
    records = cut(layer_records(scored, scan_id, created_at))
    store.best_effort(store.append_records, records, f"{folder}/records")
    payloads = store.file_payloads(records.select("scan_id", "path").distinct(), records)
    parts = {"payloads": payloads.select("scan_id", "path", F.to_json("metrics").alias("metrics"), F.to_json("errors").alias("errors"), "refactor_score")}
    parts |= {name: rows.withColumn("scan_id", F.lit(scan_id).cast("long")) for name, rows in children.items()}
    spark = scored.sparkSession
    store.best_effort(scan_store(spark, folder).replace, parts, spark.createDataFrame([(scan_id,)], "scan_id long"))
    return scoring.summarise(scored, "path")


def layer_failures(records: DataFrame) -> DataFrame:
    """For each scan and layer: paths, paths with errors, and metrics that are unknown."""
    unknown = F.size(F.map_filter("metrics", lambda _, v: v.isNull()))
    return records.groupBy("scan_id", "layer").agg(F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("files_with_errors"), F.sum(unknown).alias("unknown_metrics"))
