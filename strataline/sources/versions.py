"""Tables that change together: rows under versions, and a log of commits that says which versions count.

A write puts its rows into each table's folder `version=<id>`, and the scopes that it replaces or deletes into a table
of scopes; nothing of it is seen before its commit, one small file whose number is created once and never replaced. A
run that dies between two tables leaves rows without a commit, and readers go on with the old version of every table.
Readers take for each scope the version of its last commit and join it to the rows. A delete is a commit of scopes
without rows, so it cascades to all tables at once. `vacuum` removes versions that no scope needs any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut

#: Tries of a commit against others before it gives up.
TRIES = 20


class Raced(RuntimeError):
    """Somebody else has committed since the state was read."""


class Store:
    """scope: the column by which rows are replaced and deleted; tables: name -> schema without scope (as DDL)."""

    def __init__(self, spark: SparkSession, folder: str, scope: str, tables: dict[str, str], kind: str = "long"):
        self.spark, self.folder, self.scope, self.kind, self.tables = spark, folder.rstrip("/"), scope, kind, tables

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        path, files = self._path(name)
        schema = f"{self.scope} {self.kind}, {schema}, version string"
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(str(path))

    def commits(self) -> list[tuple[int, str]]:
        """(number, version) of all commits, one small file each."""
        path, files = self._path("commits")
        if not files.exists(path):
            return []
        found = self.spark.read.schema("number long, version string").json(str(path))
        return sorted((r["number"], r["version"]) for r in found.collect())

    def _commit(self, version: str, after: int | None) -> int:
        """Create the next number's file; after: the number that the writer has seen, beyond which nothing may have been committed."""
        for _ in range(TRIES):
            number = max([n for n, _ in self.commits()], default=0) + 1
            if after is not None and number != after + 1:
                raise Raced(f"commit {number - 1} came after {after}")
            path, files = self._path("commits", f"{number:012}.json")
            try:
                out = files.create(path, False)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                    raise
                continue
            out.write((json.dumps({"number": number, "version": version}) + "\n").encode())
            out.close()
            return number
        raise Raced("too many commits at once")

    def current(self) -> DataFrame:
        """scope and version of every scope that is there, its last commit's."""
        rows = self.spark.createDataFrame(self.commits() or [], "number long, version string")
        last = self._read("scopes", "deleted boolean").join(rows, "version").groupBy(self.scope).agg(F.max_by(F.struct("version", "deleted"), "number").alias("v"))
        return last.where("not v.deleted").select(self.scope, F.col("v.version").alias("version"))

    def read(self, name: str) -> DataFrame:
        """A table's rows as of the last commits."""
        return self._read(name, self.tables[name]).join(self.current(), [self.scope, "version"]).drop("version")

    def replace(self, parts: dict[str, DataFrame], scopes: DataFrame | None = None, after: int | None = None) -> int:
        """Commit the parts' rows in place of all that their scopes had in any table; scopes: those that are replaced, rows or not, by default those of the parts."""
        version = uuid.uuid4().hex
        found = [rows.select(F.col(self.scope).cast(self.kind)) for rows in parts.values()] if scopes is None else [scopes.select(F.col(self.scope).cast(self.kind))]
        try:
            for name, rows in parts.items():
                columns = [c.strip().split()[0] for c in self.tables[name].split(", ")]
                rows.select(F.col(self.scope).cast(self.kind), *columns).write.parquet(f"{self.folder}/{name}/version={version}")
            self._scoped(reduce(DataFrame.unionByName, found), version, False)
            return self._commit(version, after)
        except BaseException:
            self._forget(version)
            raise

    def delete(self, scopes: DataFrame, after: int | None = None) -> int:
        """Commit that these scopes have no rows in any table."""
        version = uuid.uuid4().hex
        self._scoped(scopes.select(F.col(self.scope).cast(self.kind)), version, True)
        return self._commit(version, after)

    def _scoped(self, scopes: DataFrame, version: str, deleted: bool) -> None:
        scopes.distinct().select(self.scope, F.lit(deleted).alias("deleted")).write.parquet(f"{self.folder}/scopes/version={version}")

    def _forget(self, version: str) -> None:
        for name in [*self.tables, "scopes"]:
            path, files = self._path(name, f"version={version}")
            files.delete(path, True)

    def vacuum(self) -> list[str]:
        """Delete the rows of committed versions that are no scope's version any more; gives these versions. Runs under way have no commit and stay."""
        needed = {r[0] for r in self.current().select("version").distinct().collect()}
        gone = []
        for _, version in self.commits():
            held = [p for p in (self._path(name, f"version={version}") for name in self.tables) if p[1].exists(p[0])]
            if version not in needed and held:
                for path, files in held:
                    files.delete(path, True)
                gone.append(version)
        return gone


class KeyedTable:
    """Rows with a key and unique columns, changed by batches of inserts, updates and deletes.

    A batch is checked against the rows and against itself; what breaks a key is returned with a reason, the rest is
    committed. Where somebody else has committed meanwhile, the batch is checked again on the new state.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: str, unique: list[list[str]] = (), kind: str = "long"):
        self.key, self.unique, self.names = key, [list(u) for u in unique], [c.strip().split()[0] for c in columns.split(", ")]
        self.store = Store(spark, folder, key, {"rows": columns}, kind)

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def apply(self, changes: DataFrame, checked: Callable[[], None] | None = None) -> tuple[DataFrame, DataFrame]:
        """changes(ordinal, op, key, columns) -> (accepted, rejected with reason). checked: called before a commit (a hook for tests)."""
        for _ in range(TRIES):
            seen = max([n for n, _ in self.store.commits()], default=0)
            marked = cut(judge(changes, self.read(), self.key, self.unique))
            good = marked.where("reason is null").drop("reason")
            if checked:
                checked()
            try:
                self._commit(good, seen)
            except Raced:
                continue
            return good, marked.where("reason is not null")
        raise Raced("too many batches at once")

    def _commit(self, good: DataFrame, seen: int) -> None:
        """All accepted rows in one commit: puts and deletes are scopes of one version, a delete being a scope without rows."""
        puts = good.where("op <> 'delete'").select(self.key, *self.names)
        self.store.replace({"rows": puts}, good.select(self.key), after=seen)

    def get_or_create(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of the wanted keys; those that are missing are made and inserted, and where another was faster, its rows count."""
        asked = wanted.select(self.key).distinct()
        missing = asked.join(self.read().select(self.key), self.key, "left_anti")
        if not missing.isEmpty():
            made = make(missing).withColumn("op", F.lit("insert")).withColumn("ordinal", F.lit(0).cast("long"))
            self.apply(made)
        return self.read().join(asked, self.key, "left_semi")


def judge(changes: DataFrame, rows: DataFrame, key: str, unique: list[list[str]] = ()) -> DataFrame:
    """changes with the reason why each is rejected, null where it is not.

    Of several changes of one key the first by ordinal counts ("repeated"); an insert needs a new key ("exists"), an
    update or delete a known one ("missing"); what an insert or update sets in unique columns may belong neither to
    another row ("taken") nor to an earlier change of the batch ("taken in batch"). Values of rows that the same batch
    deletes or changes still count as taken. Nulls are no key ("no key") and clash with nothing in unique columns.
    """
    first = Window.partitionBy(key).orderBy("ordinal")
    held = rows.select(F.col(key).alias("_held"))
    out = changes.withColumn("_nth", F.row_number().over(first)).join(held, F.col(key) == F.col("_held"), "left")
    put = F.col("op").isin("insert", "update")
    reasons = [
        F.when(F.col(key).isNull(), "no key"), F.when(F.col("_nth") > 1, "repeated"), F.when((F.col("op") == "insert") & F.col("_held").isNotNull(), "exists"),
        F.when((F.col("op") != "insert") & F.col("_held").isNull(), "missing"),
    ]
    for k, columns in enumerate(unique):
        owner = rows.select(F.col(key).alias(f"_owner{k}"), *(F.col(c).alias(f"_{k}{c}") for c in columns))
        same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{k}{c}") for c in columns))
        out = out.join(owner, same, "left").drop(*(f"_{k}{c}" for c in columns))
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        turn = F.row_number().over(Window.partitionBy(*columns, F.when(~known, F.col("ordinal"))).orderBy((~put).cast("int"), "ordinal", key))
        out = out.withColumn(f"_turn{k}", F.when(known & put, turn))
        reasons += [F.when(put & F.col(f"_owner{k}").isNotNull() & (F.col(f"_owner{k}") != F.col(key)), "taken"), F.when(F.col(f"_turn{k}") > 1, "taken in batch")]
    return out.withColumn("reason", F.coalesce(*reasons)).drop("_nth", "_held", *(f"_{w}{k}" for k in range(len(unique)) for w in ("owner", "turn")))
