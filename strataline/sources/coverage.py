"""Coverage of tests from the SQLite files that the coverage tool leaves in a source tree.

`coverage_files` is a data source: a task reads one file and gives a row for each measured source file, with the lines
that ran. Their sets of lines are bitmaps, one for each context, whose bit i of byte j stands for line 8 j + i; files
that were measured by branches hold pairs of lines instead. A source goes by the data file in the nearest folder above
it, as `coverage_of_sources` finds with the longest known prefix of its folder.
"""

from __future__ import annotations

import ast
import json
import os
import re
import sqlite3
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from ..functions.paths import EXCLUDED_DIRS
from ..operators.longest import longest_known
from ..shipping import ship

DATA_FILE = ".coverage"
FILES = "root string, folder string, path string, lines array<int>, error string"
PRAGMA = re.compile(r"#\s*(pragma|PRAGMA)[:\s]?\s*(no|NO)\s*(cover|COVER)")


def lines_of(bitmap: bytes) -> set[int]:
    return {8 * j + i for j, byte in enumerate(bitmap) for i in range(8) if byte >> i & 1}


def executed(path: str):
    """(recorded path, sorted lines) of each file in a data file, over all contexts, one file at a time."""
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
    try:
        for number, name in db.execute("SELECT id, path FROM file ORDER BY id").fetchall():
            lines = set()
            for (bitmap,) in db.execute("SELECT numbits FROM line_bits WHERE file_id = ?", (number,)):
                lines |= lines_of(bitmap)
            for pair in db.execute("SELECT fromno, tono FROM arc WHERE file_id = ?", (number,)):
                lines.update(n for n in pair if n > 0)  # negative numbers enter and leave a piece of code
            yield name, sorted(lines)
    finally:
        db.close()


def placed(name: str, root: str, folder: str) -> str | None:
    """A recorded path relative to the root; one that is relative starts at the data file's folder; null for one outside."""
    full = os.path.normpath(name if os.path.isabs(name) else os.path.join(root, folder, name))
    inside = os.path.relpath(full, root)
    return None if inside.split(os.sep)[0] == os.pardir else inside.replace(os.sep, "/")


class DataFile(InputPartition):
    def __init__(self, root: str, folder: str):
        self.root, self.folder = root, folder


class CoverageReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = [os.path.normpath(r) for r in roots]

    def partitions(self) -> list[DataFile]:
        """One for each data file; only names of folders are walked."""
        out = []
        for root in self.roots:
            for at, folders, files in os.walk(root):
                folders[:] = sorted(f for f in folders if f not in EXCLUDED_DIRS)
                if DATA_FILE in files:
                    inside = os.path.relpath(at, root)
                    out.append(DataFile(root, "" if inside == os.curdir else inside.replace(os.sep, "/")))
        return out or [DataFile("", "")]

    def read(self, partition: DataFile):
        if not partition.root:
            return
        root, folder = partition.root, partition.folder
        yield (root, folder, None, None, None)  # the file counts for its folder, whatever it holds
        try:
            for name, lines in executed(os.path.join(root, folder, DATA_FILE)):
                path = placed(name, root, folder)
                if path is not None:
                    yield (root, folder, path, lines, None)
        except sqlite3.Error as e:
            yield (root, folder, None, None, f"Failed to read coverage: {e}")


class CoverageFiles(DataSource):
    """Option roots: a JSON list of folders that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "coverage_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> CoverageReader:
        return CoverageReader(json.loads(self.options["roots"]))


def read_coverage(spark: SparkSession, roots: list[str]) -> DataFrame:
    """root, folder, path, lines, error: a row without a path for each data file, one for each file that it measured, one with an error where it cannot be read."""
    ship(spark).dataSource.register(CoverageFiles)
    return spark.read.format("coverage_files").option("roots", json.dumps(roots)).load()


def starts(node: ast.stmt) -> int:
    """The first line of a statement with its decorators."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def statement_lines(source: str | None) -> list[int] | None:
    """The first lines of a source's statements; null where it does not parse.

    Docstrings, other bare constants and global or nonlocal declarations run nothing and do not count. A line that
    asks not to be covered goes, and if it heads a block (or is a decorator of one), that block with it; branches that
    follow the block stay.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, TypeError, RecursionError):
        return None
    asked = {n for n, line in enumerate(source.split("\n"), 1) if PRAGMA.search(line)}
    out, gone = set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.stmt):
            first, body = starts(node), getattr(node, "body", None)
            head = starts(body[0]) - 1 if body else node.end_lineno
            if asked & set(range(first, max(head, node.lineno) + 1)):
                gone |= set(range(first, (body[-1] if body else node).end_lineno + 1))
            if not isinstance(node, ast.Global | ast.Nonlocal) and not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):
                out |= {node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))}
        elif isinstance(node, ast.ExceptHandler | ast.match_case):
            at = node.lineno if isinstance(node, ast.ExceptHandler) else node.pattern.lineno
            out.add(at)
            if at in asked:
                gone |= set(range(at, node.body[-1].end_lineno + 1))
    return sorted(out - gone)


def coverage_of_sources(sources: DataFrame, data: DataFrame) -> DataFrame:
    """path, n_statements, n_missing of sources(path, source) that have a data file above them; data: one root of read_coverage.

    A source that its data file did not measure misses all statements; one without a data file, with one that cannot
    be read, or that does not parse, has no row, which counts as no coverage.
    """
    ship(sources.sparkSession)

    @pandas_udf("array<int>")
    def statements(source: pd.Series) -> pd.Series:
        return pd.Series([statement_lines(s) for s in source], dtype=object)

    code = sources.where("path is not null").select("path", statements("source").alias("statements")).where("statements is not null")
    return measured(code, data)


def measured(code: DataFrame, data: DataFrame) -> DataFrame:
    """path, n_statements, n_missing of code(path, statements), an array of lines."""
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    nearest = longest_known(code.select(folder.alias("name")), data.select(F.col("folder").alias("name")), "/")
    broken = data.where("error is not null").select("folder").distinct()
    lines = data.where("path is not null").groupBy("folder", "path").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    at = code.withColumn("name", folder).join(nearest, "name").withColumnRenamed("prefix", "folder").join(broken, "folder", "left_anti")
    both = at.join(lines, ["folder", "path"], "left")
    missing = F.size(F.array_except("statements", F.coalesce("lines", F.array().cast("array<int>"))))
    return both.select("path", F.size("statements").alias("n_statements"), missing.alias("n_missing"))
