"""Refactor-priority scores: four component scores, one score with confidence, band, contributions and summary.

Input: one row per file with the metrics as columns; a missing column counts as unknown. Weights are checked when
the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, coverage_of, density, mean_of, number, offset, positive, saturate, total_of
from ..sources.storage import cut

#: Weights of the metrics of each component (fixed values).
WEIGHTS: dict[str, dict[str, float]] = {
    "complexity": {"max_cyclomatic": 0.18, "max_cognitive": 0.18, "avg_cyclomatic": 0.07, "avg_cognitive": 0.07, "size": 0.18, "long_conditions": 0.07, "if_else": 0.06, "parameters": 0.07, "fixme": 0.06, "empty_except": 0.04, "coverage_gap": 0.02},
    "history": {"churn_to_size": 0.25, "recent": 0.18, "bug_fix_ratio": 0.18, "complexity_growth": 0.12, "bug_fixes": 0.10, "co_change": 0.10, "contributors": 0.04, "recent_ratio": 0.03},
    "duplication": {"lines": 0.24, "blocks": 0.22, "semantic_blocks": 0.22, "group": 0.12, "candidates": 0.10, "similarity": 0.10},
    "architecture": {"runtime_cycle": 0.18, "cycle": 0.05, "betweenness": 0.15, "dependents": 0.14, "fan_out": 0.30, "fan_in": 0.12, "instability": 0.06},
}
#: Weights of the components, and how far one that stands out lifts the score (fixed values).
COMPONENTS = {"complexity": 0.30, "history": 0.25, "duplication": 0.25, "architecture": 0.20}
DOMINANCE = {"complexity": 1.0, "history": 0.7, "duplication": 0.9, "architecture": 0.8}
BONUS, LEAST_COVERAGE = 0.65, 0.50
BANDS = (("critical", 0.70), ("high", 0.55), ("medium", 0.31))
TOP = 10


def checked(weights: Mapping[str, float], expected: Mapping[str, object]) -> dict[str, float]:
    """The weights, if their names are those expected, all are finite and not negative and they sum to 1."""
    if missing := sorted(set(expected) - set(weights)):
        raise ValueError(f"missing scores: {missing}")
    if extra := sorted(set(weights) - set(expected)):
        raise ValueError(f"unexpected scores: {extra}")
    if any(not isfinite(w) or w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be finite, not negative and sum to 1.0")
    return dict(weights)


def parts(m) -> dict[str, dict[str, Column]]:
    """The scores of all metrics; m gives a metric's column by name."""
    sizes = [m("lines_of_code"), m("source_lines_of_code"), m("logical_lines_of_code")]
    physical, code = F.greatest(*sizes), F.coalesce(sizes[1], sizes[2], sizes[0])
    updates, recent = m("update_count"), m("recent_update_count")
    changes = positive(updates - 1)
    recent_changes = F.when(recent.isNotNull() & changes.isNotNull(), F.least(positive(recent), changes))
    copied = m("duplicate_loc_count")
    share = F.when(recent_changes.isNotNull() & (changes > 0), clamp(F.try_divide(recent_changes, changes))).when(changes == 0, F.lit(0.0))
    return {
        "complexity": {
            "max_cyclomatic": saturate(positive(m("max_cyclomatic_complexity")), 15), "max_cognitive": saturate(positive(m("max_cognitive_complexity")), 25), "avg_cyclomatic": saturate(positive(m("average_cyclomatic_complexity")), 8), "avg_cognitive": saturate(positive(m("average_cognitive_complexity")), 12),
            "size": saturate(physical, 300), "long_conditions": density(m("long_conditions_count"), physical, 5), "if_else": offset(m("max_if_else_chain_length"), 1, 5), "parameters": offset(m("average_parameters_count"), 3, 4),
            "fixme": density(m("count_of_fixme_comments"), physical, 5), "empty_except": density(m("count_of_empty_except_blocks"), physical, 3), "coverage_gap": 1 - clamp(m("testing_coverage") / 100),
        },
        "history": {
            "churn_to_size": saturate(m("churn_to_size_ratio"), 8), "recent": saturate(recent_changes, 12), "bug_fix_ratio": saturate(m("bug_fix_ratio") * F.try_divide(changes, changes + 2), 0.5), "complexity_growth": saturate(positive(m("cyclomatic_complexity_growth_rate")), 5),
            "bug_fixes": saturate(m("bug_fix_commit_count"), 6), "co_change": saturate(m("co_change_file_count"), 12), "contributors": offset(m("contributors_count"), 1, 5), "recent_ratio": share,
        },
        "duplication": {
            "lines": clamp(copied / F.when(code.isNotNull(), F.greatest(F.lit(1.0), code))) * saturate(copied, 30), "blocks": saturate(m("duplicate_blocks_count"), 4), "semantic_blocks": saturate(m("semantic_duplicate_blocks_count"), 3),
            "group": offset(m("duplication_group_size"), 1, 4), "candidates": saturate(m("duplicate_file_candidates_count"), 5), "similarity": offset(m("max_similarity_score"), 0.75, 0.25),
        },
        "architecture": {
            "runtime_cycle": offset(m("runtime_circular_dependency_size"), 1, 2), "cycle": offset(m("circular_dependency_size"), 1, 2), "betweenness": saturate(m("betweenness_centrality"), 0.05), "dependents": saturate(m("transitive_dependents_count"), 30),
            "fan_out": saturate(m("fan_out"), 15), "fan_in": saturate(m("fan_in"), 15), "instability": clamp(m("instability_index")),
        },
    }


def band(score: Column, bands=BANDS) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, least in bands:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(F.lit("low"))


def score_files(metrics: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, bands=BANDS) -> DataFrame:
    """The rows with component scores, refactor_score, score_confidence, priority_band, contributions and decision_errors.

    A component whose weights are wrong has no score and adds an error.
    """
    known = set(metrics.columns)
    unknown = F.lit(None).cast("double")
    inputs: dict[str, Column] = {}

    def metric(name: str) -> Column:
        inputs[f"_m_{name}"] = number(F.col(name)) if name in known else unknown
        return F.col(f"_m_{name}")

    # Each step names its columns, so that no expression is written out more than once.
    scores, errors, weighed, sums, scored = {}, [], {}, {}, {}
    for name, columns in parts(metric).items():
        try:
            by = checked(weights[name], columns)
        except ValueError as e:
            sums |= {f"{name}_coverage": F.lit(0.0), f"_t_{name}": unknown}
            errors.append(f"{name}_score failed: {e}")
        else:
            scores |= {f"_p_{name}_{k}": c for k, c in columns.items()}
            weighed[name] = [(by[k], F.col(f"_p_{name}_{k}")) for k in columns]
            sums |= {f"{name}_coverage": coverage_of(weighed[name]), f"_t_{name}": total_of(weighed[name])}
        scored[f"{name}_score"] = F.when(F.col(f"{name}_coverage") >= LEAST_COVERAGE - 1e-12, F.round(mean_of(F.col(f"_t_{name}"), F.col(f"{name}_coverage")), 6))
    out = metrics.withColumns(inputs).withColumns(scores or {"_none": unknown}).withColumns(sums).withColumns(scored)
    component = {k: F.col(f"{k}_score") for k in COMPONENTS}
    if errors:  # one component that cannot be computed leaves no score
        out = out.withColumns({"base_score": unknown, "bonus": F.lit(0.0), "refactor_score": unknown, "dominant": F.lit(None).cast("string")})
    else:
        by = [(COMPONENTS[k], c) for k, c in component.items()]
        out = out.withColumns({"_base_total": total_of(by), "_base_cover": coverage_of(by)}).withColumn("base_score", mean_of(F.col("_base_total"), F.col("_base_cover")))
        excess = [F.struct(F.coalesce(DOMINANCE[k] * positive(c - F.col("base_score")), F.lit(0.0)).alias("excess"), F.lit(-n).alias("order"), F.lit(k).alias("name")) for n, (k, c) in enumerate(component.items())]
        out = out.withColumn("top_excess", F.greatest(*excess)).withColumn("bonus", BONUS * F.col("top_excess.excess"))
        out = out.withColumn("dominant", F.when(F.col("bonus") > 0, F.col("top_excess.name"))).withColumn("refactor_score", F.round(clamp(F.col("base_score") + F.col("bonus")), 6)).drop("top_excess")
    confidence = sum((COMPONENTS[k] * F.col(f"{k}_coverage") for k in COMPONENTS), F.lit(0.0))
    out = out.withColumn("score_confidence", F.round(F.coalesce(confidence, F.lit(0.0)), 6)).withColumn("priority_band", band(F.col("refactor_score"), bands))
    available = sum((F.when(c.isNotNull(), F.lit(COMPONENTS[k])).otherwise(0.0) for k, c in component.items()), F.lit(0.0))
    raw = F.col("base_score") + F.col("bonus")
    scale = F.when(raw > 1, F.try_divide(F.lit(1.0), raw)).otherwise(1.0)
    shares = F.array(*(F.struct(F.round(scale * (F.try_divide(COMPONENTS[k] * c, available) + F.when(F.col("dominant") == k, F.col("bonus")).otherwise(0.0)), 6).alias("share"), F.lit(-n).alias("order"), F.lit(k).alias("component")) for n, (k, c) in enumerate(component.items())))
    kept = F.transform(F.sort_array(F.filter(shares, lambda s: s["share"] > 0), asc=False), lambda s: F.struct(s["component"].alias("component"), s["share"].alias("share")))
    out = out.drop(*(c for c in out.columns if c.startswith(("_m_", "_p_", "_t_", "_base", "_none"))))
    return out.withColumn("contributions", kept).withColumn("decision_errors", F.array(*map(F.lit, errors)).cast("array<string>"))


def summarise(scored: DataFrame, path: str = "file_path") -> DataFrame:
    """One row: files evaluated, scored and not, mean and highest score, files in each band, the ten with the highest score."""
    scored = cut(scored.select(path, "refactor_score", "priority_band"))
    top = scored.where("refactor_score is not null").orderBy(F.desc("refactor_score"), F.asc(path)).limit(TOP)
    listed = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("refactor_score")).alias("order"), F.col(path).alias("file_path")))), lambda s: s["file_path"]).alias("top_candidates"))
    return scored.agg(
        F.count("*").alias("files_evaluated"), F.count("refactor_score").alias("files_scored"), F.count_if(F.col("refactor_score").isNull()).alias("files_unscored"),
        F.round(F.avg("refactor_score"), 6).alias("average_score"), F.max("refactor_score").alias("max_score"), *(F.count_if(F.col("priority_band") == b).alias(f"{b}_count") for b in ("critical", "high", "medium", "low")),
    ).crossJoin(listed)  # fmt: skip  # one row each
