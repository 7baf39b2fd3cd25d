"""Paths, module names and file kinds as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are no source (fixed values).
EXCLUDED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache")
#: Language by suffix (fixed values).
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript React", ".ts": "TypeScript", ".tsx": "TypeScript React", ".java": "Java", ".cs": "C#", ".cpp": "C++", ".cc": "C++", ".c": "C", ".go": "Go",
    ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".kt": "Kotlin", ".swift": "Swift", ".vue": "Vue", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sql": "SQL", ".md": "Markdown",
}


def canonical(path: Column) -> Column:
    """A relative path with single slashes, or null where it is absolute, has a drive or dot segments, or is empty."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    joined = F.array_join(F.filter(F.split(slashed, "/"), lambda p: p != ""), "/")
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.exists(F.split(slashed, "/"), lambda p: p.isin(".", "..")) | (joined == "")
    return F.when(~bad, joined)


def is_source(path: Column) -> Column:
    return path.endswith(".py") & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))


def directory(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path, "/?[^/]+$", ""), F.lit("")), F.lit("(root)"))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("Unknown"))


def module_name(path: Column) -> Column:
    """Dotted name: without suffix, from behind the first src on, without a last __init__."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    at = F.array_position(parts, "src").cast("int")
    kept = F.when(at > 0, F.slice(parts, at + 1, F.size(parts))).otherwise(parts)
    kept = F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) == "__init__"), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return F.array_join(kept, ".")
