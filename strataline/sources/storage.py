"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one, which spark.checkpoint.dir names; it goes when the application ends.

    Where the setting is unset and Spark is local (tests), a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    folder = f"{found.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


#: Whether a write's shuffle files go as soon as it is done.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written to the shared folder and read back, so that plans stay short, work is done once and lost executors do no harm; the write's shuffle files go with it."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES, "false")
    spark.conf.set(SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLES, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() has made, when nothing reads them any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
