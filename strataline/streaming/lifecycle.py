"""The life cycle of scans as a stateful stream: transitions come as rows, each scan keeps its state, and a timer ends scans that never do.

pending creates a scan; pending -> running; running -> succeeded; pending or running -> failed or cancelled. What is not
allowed is refused and leaves the state alone, so a repeated or late transition does no harm; rows of one batch are
applied in order of time. A scan that is still pending or running `limit` seconds after its last accepted
transition fails at that time: when a later row comes, or once the watermark says that none of that time can still come.
So where batches begin and end changes nothing; rows behind the watermark are dropped.

Spark's groups are hash buckets of scans, whose states are held as one Arrow table, since a call for each scan costs more
than all that it does. A bucket's timer is that of its first scan due; whenever it is called, all that are due fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship
from ..sources.storage import shared_dir

#: to -> from; None is a scan that is not known.
ALLOWED = {"pending": {None}, "running": {"pending"}, "succeeded": {"running"}, "failed": {"pending", "running"}, "cancelled": {"pending", "running"}}
OPEN, TIMED_OUT = {"pending", "running"}, "no transition within the limit"
STATE = "status string, started_us long, finished_us long, error_message string, nth long, last_us long"
SCANS = pa.schema([("scan_id", pa.int64()), ("status", pa.string()), ("started_us", pa.int64()), ("finished_us", pa.int64()), ("error_message", pa.string()), ("nth", pa.int64()), ("last_us", pa.int64())])
BUCKETS = 4096
OUT = f"scan_id long, at_us long, asked string, accepted boolean, {STATE}"  # nth: the how manyth transition of the scan, refused ones too


def step(state: tuple, asked: str, at_us: int, why: str | None) -> tuple[bool, tuple]:
    """Whether a transition is allowed, and the state after it: (status, started, finished, error, transitions, last)."""
    status, started, _, _, nth, last = state
    nth = (nth or 0) + 1
    if status not in ALLOWED.get(asked, ()):
        return False, (*state[:4], nth, last)
    if asked == "running" and started is None:
        started = at_us
    return True, (asked, started, None if asked in OPEN else at_us, why if asked == "failed" else None, nth, at_us)


def packed(states: dict) -> bytes:
    """scan_id -> state as a compressed Arrow stream."""
    rows = [(key, *state) for key, state in states.items()]
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCANS, strict=True)], schema=SCANS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCANS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> dict:
    columns = [c.to_pylist() for c in pa.ipc.open_stream(held).read_all().columns]
    return {key: state for key, *state in zip(*columns, strict=True)}


def transitions(changes: DataFrame, limit: int | None = None, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """changes(scan_id, status, at, error_message), a stream or a table -> a row for each transition: asked, accepted, and the scan's state after it. limit: seconds; buckets: groups that scans are dealt to, part of a stream's checkpoint."""
    ship(changes.sparkSession)

    def due(state: tuple) -> float:
        return state[5] + limit * 1_000_000 if limit is not None and state[0] in OPEN else float("inf")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = unpacked(held.get[0]) if held.exists else {}
        rows = []

        def go(scan: int | None, asked: str, at: int, why: str | None) -> None:
            done, states[scan] = step(states.get(scan, (None,) * 6), asked, at, why)
            rows.append((scan, at, asked, done, *states[scan]))

        if not held.hasTimedOut:
            found = pd.concat(list(frames)).sort_values(["at_us", "status"], kind="stable")
            scans = [None if pd.isna(x) else int(x) for x in found["scan_id"]]
            for scan, asked, at, why in zip(scans, found["status"], found["at_us"].tolist(), found["error_message"], strict=True):
                if scan in states and int(at) > (end := due(states[scan])):  # its timer was due before, whichever batch the row came in
                    go(scan, "failed", int(end), TIMED_OUT)
                go(scan, asked, int(at), why)
        if limit is not None:
            now = held.getCurrentWatermarkMs()
            ends = {scan: int(due(state)) for scan, state in states.items() if state[0] in OPEN}
            over = [scan for scan, end in ends.items() if now > 0 and end // 1000 + 1 < now]
            for scan in over:
                go(scan, "failed", ends.pop(scan), TIMED_OUT)
            if ends:
                held.setTimeoutTimestamp(max(min(ends.values()) // 1000, now) + 1)
        held.update((packed(states),))
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(rows, columns=names, dtype=object).astype({"accepted": bool, "scan_id": "Int64", "started_us": "Int64", "finished_us": "Int64", "last_us": "Int64"})

    stamped = changes.withWatermark("at", late).select(F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).alias("bucket"), "scan_id", "at", F.unix_micros("at").alias("at_us"), "status", "error_message")
    timeout = GroupStateTimeout.NoTimeout if limit is None else GroupStateTimeout.EventTimeTimeout
    return stamped.groupBy("bucket").applyInPandasWithState(fold, OUT, "scans binary", "append", timeout)


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, whether it is one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(spark.read.parquet(str(path)).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(str(path))
    return reader.option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives from what its source holds now, as a table."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def last_states(made: DataFrame) -> DataFrame:
    """scan_id, its last state, and how many transitions were accepted and refused."""
    rows = made.groupBy("scan_id").agg(F.max_by(F.struct("status", "started_us", "finished_us", "error_message"), "nth").alias("s"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    return rows.select("scan_id", "s.status", F.timestamp_micros("s.started_us").alias("started_at"), F.timestamp_micros("s.finished_us").alias("finished_at"), "s.error_message", "accepted", "refused")
