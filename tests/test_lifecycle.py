"""The stream of transitions against apply_status, one transition at a time."""

import random
from datetime import datetime, timedelta

from strataline.plans import scans
from strataline.streaming import lifecycle

START = datetime(2026, 1, 1)
CHANGES = "scan_id long, status string, at timestamp, error_message string"
SCANS = "scan_id long, status string, started_at timestamp, finished_at timestamp, updated_at timestamp, error_message string"


def run(spark, tmp_path, batches, **options):
    """A stream over the batches, a file and a micro-batch each."""
    source = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    return lifecycle.drained(lifecycle.transitions(stream, **options))


def test_late_and_repeated_transitions_equal_apply_status(spark, tmp_path):
    rng = random.Random(2)
    names = ["pending", "running", "succeeded", "failed", "cancelled"]
    batches = []
    for b in range(3):
        rows = [(s, rng.choice(names[: 2 + 2 * b]), START + timedelta(minutes=20 * b, seconds=rng.randrange(1500)), f"e{s}") for s in range(12) for _ in range(rng.randint(0, 3))]
        batches.append(rows + rows[:4])  # repeated
    made = run(spark, tmp_path, batches, late="3 hours")
    got = {r["scan_id"]: (r["status"], r["started_at"], r["finished_at"], r["error_message"], r["accepted"]) for r in lifecycle.last_states(made).collect()}
    now, accepted = {}, {}
    for rows in batches:
        for row in sorted(rows, key=lambda r: (r[2], r[1])):
            s, status, at, why = row
            accepted.setdefault(s, 0)
            if s not in now:
                if status == "pending":
                    now[s] = (s, "pending", None, None, at, None)
                    accepted[s] += 1
                continue
            after = tuple(scans.apply_status(spark.createDataFrame([now[s]], SCANS), spark.createDataFrame([row], CHANGES)).first())
            accepted[s] += after[1] != now[s][1]
            now[s] = after
    want = {s: (*((now[s][1], now[s][2], now[s][3], now[s][5]) if s in now else (None,) * 4), n) for s, n in accepted.items()}
    assert got == want and {v[0] for v in got.values()} >= {"pending", "succeeded", "failed"} - {None}
    assert made.count() == sum(map(len, batches))


def test_scans_that_never_end_fail(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [[(1, "pending", at(0), None), (1, "running", at(1), None), (2, "pending", at(0), None), (3, "pending", at(0), None)], [(2, "running", at(50), None), (3, "failed", at(40), "broke")], [(9, "pending", at(300), None)], [(1, "succeeded", at(299), None), (2, "succeeded", at(1), None)]]
    made = run(spark, tmp_path, batches, limit=3600, late="10 minutes")
    got = {r["scan_id"]: (r["status"], r["error_message"]) for r in lifecycle.last_states(made).collect()}
    assert got == {1: ("failed", lifecycle.TIMED_OUT), 2: ("failed", lifecycle.TIMED_OUT), 3: ("failed", "broke"), 9: ("pending", None)}
    refused = {(r["scan_id"], r["asked"]) for r in made.where("not accepted").collect()}
    assert refused == {(1, "succeeded")}  # after its timer; that of scan 2 was behind the watermark


def test_scans_share_the_state_of_a_bucket(spark, tmp_path):
    """Timers of scans that no row comes for, in buckets that rows come for in every batch, against each scan on its own."""
    rng = random.Random(5)
    batches = [[(s, rng.choice(["pending", "pending", "running", "succeeded", "cancelled"]), START + timedelta(minutes=30 * b, seconds=rng.randrange(1500)), f"e{s}") for s in range(60 * b, 60 * b + 90) for _ in range(rng.randint(0, 3))] for b in range(4)]
    made = run(spark, tmp_path, batches, limit=1800, late="40 minutes", buckets=3)
    states = [tuple(r) for r in made.select("scan_id", "nth").collect()]
    assert len(states) == len(set(states))
    us = lambda at: round((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    end = us(max(at for rows in batches for _, _, at, _ in rows) - timedelta(minutes=40))
    want = {}
    for s, status, at, why in sorted((r for rows in batches for r in rows), key=lambda r: (r[2], r[1])):
        state, done = want.get(s, ((None,) * 6, 0))
        if state[0] in lifecycle.OPEN and us(at) > state[5] + 1_800_000_000:
            state, done = lifecycle.step(state, "failed", state[5] + 1_800_000_000, lifecycle.TIMED_OUT)[1], done + 1
        ok, state = lifecycle.step(state, status, us(at), why)
        want[s] = (state, done + ok)
    late = {s for s, (state, _) in want.items() if state[0] in lifecycle.OPEN and state[5] + 1_800_000_000 < end - 2000}
    for s in late:
        want[s] = (lifecycle.step(want[s][0], "failed", want[s][0][5] + 1_800_000_000, lifecycle.TIMED_OUT)[1], want[s][1] + 1)
    got = {r["scan_id"]: (r["status"], r["error_message"], r["accepted"]) for r in lifecycle.last_states(made).collect()}
    assert got == {s: (state[0], state[3], n) for s, (state, n) in want.items()} and len(late) > 20
