"""Timers and initial state over several batches of a stream."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from docloom.streaming import jobs, stateful

START = datetime(2024, 1, 1)
JOBS = "job_id long, seq long, ts timestamp, event string, exit_code int, message string"
KEYS = "key long, seq long, event string, terminal boolean"


def stream(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b={k}")
    return jobs.read(spark, f"{folder}/b=*", schema)


def at(hours):
    return START + timedelta(hours=hours)


def ends(spark, folder, batches, grace_hours=2):
    out = stateful.job_ends(stream(spark, folder, batches, JOBS), grace_hours * 3600, "10 minutes")
    return sorted((r.job_id, r.outcome, r.message, (r.at - START).total_seconds() / 3600) for r in jobs.run_to_end(out, uuid.uuid4().hex, "append").collect())


def test_silent_jobs_time_out(spark, tmp_path):
    """Three batches: one job goes on, one falls silent, one exits, one fails and one is silent inside a batch."""
    batches = [
        [(1, 1, at(0), "progress", None, None), (2, 1, at(0), "progress", None, None), (3, 1, at(0.1), "progress", None, None), (5, 1, at(0), "progress", None, None)],
        [(1, 2, at(1.5), "progress", None, None), (3, 2, at(1), "exit", 0, "done"), (4, 1, at(1), "exit", 3, "bad"), (3, 3, at(1.2), "error", None, "after the end")],
        [(1, 3, at(3.4), "progress", None, None), (6, 1, at(3.3), "error", None, "lost"), (5, 2, at(3.2), "exit", 0, "too late"), (2, 2, at(3.4), "exit", 0, "too late")],
    ]
    assert ends(spark, str(tmp_path / "in"), batches) == [(2, "timeout", None, 2.0), (3, "complete", "done", 1.0), (4, "failed", "bad", 1.0), (5, "timeout", None, 2.0), (6, "monitor_error", "lost", 3.3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_do_not_depend_on_the_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(12), k, at(rng.random() * 30), rng.choice(["progress"] * 12 + ["exit", "error"]), rng.randrange(2), "m") for k in range(120))
    rows = sorted(rows, key=lambda r: r[2])
    cuts = sorted(rng.sample(range(1, 120), 3))
    several = ends(spark, str(tmp_path / "a"), [rows[a:z] for a, z in zip([0, *cuts], [*cuts, 120])], 4)
    assert several == ends(spark, str(tmp_path / "b"), [rows[:60], rows[60:]], 4) and several


def test_no_row_is_lost_or_doubled_at_the_seam(spark, tmp_path):
    past = spark.createDataFrame([(1, k, f"e{k}", False) for k in range(1, 31)] + [(2, 1, "x", False), (2, 2, "end", True), (2, 3, "after", False)], KEYS)
    batches = [
        [(1, 30, "e30", False), (1, 29, "e29", False), (1, 31, "e31", False), (2, 3, "after", False)],
        [(1, 33, "e33", False), (1, 32, "e32", False), (3, 1, "new", False), (2, 4, "x", False)],
        [(1, 34, "end", True), (1, 35, "more", False), (3, 2, "new2", False)],
    ]
    live = jobs.run_to_end(stateful.live_after(past, stream(spark, str(tmp_path / "in"), batches, KEYS)), uuid.uuid4().hex, "append")
    assert sorted((r.key, r.seq, r.event) for r in live.collect()) == [(1, 31, "e31"), (1, 32, "e32"), (1, 33, "e33"), (1, 34, "end"), (3, 1, "new"), (3, 2, "new2")]
    shown = sorted((r.key, r.seq) for r in stateful.snapshot(past).collect())
    assert shown == [(1, k) for k in range(11, 31)] + [(2, 1), (2, 2)]
