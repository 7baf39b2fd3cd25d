"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from ..sources.marks import marked_by  # noqa: F401  the corpus operators have it from here
from ..sources.storage import shared_dir


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one operator: Parquet in the shared folder, deleted as soon as nothing reads them any more.

    A shuffle's files go with the write that used them, so that disk holds the live tables and one shuffle.
    """

    SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        before = self.spark.conf.get(self.SHUFFLES, "false")
        self.spark.conf.set(self.SHUFFLES, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(self.SHUFFLES, before)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths[id(df)]
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in Arrow batches of fewer rows than Spark's default, on both sides of the pipe; a user's own number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, whatever else docs holds; null texts count as empty."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def pieces(batches, rows: int = 256):
    """The same rows in small batches, so that a worker holds few of them as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mapped_texts(docs: DataFrame, name: str, kind: T.DataType, fn, text_col: str = "text", rows: int = 256) -> DataFrame:
    """docs with one more column, or a new one in its place: fn of the lists of texts, null ones as empty. All other columns pass through."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    inner = "".join(["_", *docs.columns])  # a name that no column has
    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, kind)])
    order = docs.columns if name in docs.columns else [*docs.columns, name]

    def run(batches):
        for b in pieces(batches, rows):
            made = pa.array(fn(b.column(b.num_columns - 1).to_pylist()), to_arrow_type(kind))
            keep = [k for k, n in enumerate(b.schema.names[:-1]) if n != name]
            yield pa.record_batch([*(b.column(k) for k in keep), made], [*(b.schema.names[k] for k in keep), name])

    return docs.withColumn(inner, F.coalesce(docs[text_col], F.lit(""))).mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in order))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_column, m: int):
    """crc32 of the id as text, modulo m; the id of no row counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % m
