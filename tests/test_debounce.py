"""Settled events against the batch rule: any order of arrival, ties, and a restart from the checkpoint."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from riskloom.streaming import debounce

SCHEMA = "event_id long, path string, change_type string, ts timestamp, hash string"
START = datetime(2024, 1, 1)


def rows(seed, n, spread):
    r = random.Random(seed)
    return [(i, f"p{r.randrange(4)}", r.choice(["created", "modified"]), START + timedelta(milliseconds=r.randrange(spread)), f"h{i}") for i in range(n)]


def brute(events, buffer):
    last = max(e[3] for e in events)
    wait = timedelta(seconds=buffer)
    out = set()
    for e in events:
        later = [f for f in events if f[1] == e[1] and (f[3], f[0]) > (e[3], e[0]) and f[3] <= e[3] + wait]
        if not later and e[3] + wait <= last:
            out.add((e[1], e[0]))
    return out


def write(spark, events, folder):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("buffer", [0.0, 0.7])
def test_parts_in_any_order_and_restart(spark, tmp_path, buffer):
    """Parts whose times overlap come one after the other, each by a query of its own over the same checkpoint."""
    events = rows(1, 90, 20_000) + [(100, "p0", "modified", START, "x"), (101, "p0", "modified", START, "y")]
    random.Random(2).shuffle(events)
    events.append((999, "end", "created", START + timedelta(seconds=30), "z"))
    folder, source = f"{tmp_path}/out", f"{tmp_path}/in"
    found = None
    for part in (events[:30], events[30:60], events[60:]):
        write(spark, part, source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        with debounce.store(spark):
            # Events may come as late as all others are spread, so none is too late.
            found = debounce.analyzers({"a": debounce.settled(stream, buffer, "25 seconds")}, folder)["a"]
    # The watermark stands 25 seconds behind the last event.
    told = [(r.path, r.event_id) for r in found.collect()]
    assert len(told) == len(set(told))
    closed = START + timedelta(seconds=5)
    want = {k for k in brute(events, buffer) if next(e for e in events if e[0] == k[1])[3] + timedelta(seconds=buffer) <= closed}
    assert set(told) == want and want


def test_batch_rule(spark):
    events = rows(3, 200, 60_000)
    got = debounce.settled_batch(spark.createDataFrame(events, SCHEMA), 0.5).collect()
    assert {(r.path, r.event_id) for r in got} == brute(events, 0.5)


def test_one_that_fails_leaves_the_others(spark, tmp_path):
    from pyspark.sql import functions as F

    write(spark, rows(4, 10, 1000), f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    bad = stream.withColumn("hash", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(RuntimeError, match="^bad: "):
        debounce.analyzers({"bad": bad, "good": stream}, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/good/rows").count() == 10
    again = debounce.analyzers({"good": stream}, f"{tmp_path}/out")["good"]
    assert again.count() == 10
    told = {(r.analyzer, r.files, r.found) for r in debounce.overall({"good": again}, lambda d: d.where("event_id < 3")).collect()}
    assert told == {("good", 10, 3), ("all", 10, 3)}


@pytest.mark.parametrize("buffer", [0.0, 0.005])
def test_events_at_the_end_of_the_buffer(spark, tmp_path, buffer):
    """Times a buffer apart to the microsecond, and as late as the watermark: what follows at the very end still follows."""
    r = random.Random(5)
    events = [(i, f"p{r.randrange(40)}", "modified", START + timedelta(microseconds=1000 * r.randrange(200) + r.randrange(2)), "x") for i in range(1500)]
    events += [(2000, "q", "created", START + timedelta(milliseconds=295), "x"), (2001, "q", "created", START + timedelta(milliseconds=300), "x")]
    write(spark, events, f"{tmp_path}/in")
    with debounce.store(spark):
        stream = debounce.settled(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), buffer)
        got = [(r.path, r.event_id) for r in debounce.analyzers({"a": stream}, f"{tmp_path}/out")["a"].collect()]
    assert len(got) == len(set(got)) and set(got) == brute(events, buffer)


def test_no_python_runs_for_each_path(spark, tmp_path):
    """Settling stays with Spark's own operators: a Python call for each path and each of its events did not end on large tables."""
    write(spark, rows(6, 10, 1000), f"{tmp_path}/in")
    plan = debounce.settled(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 0.5)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_changed_events_of_many_paths(spark, tmp_path):
    """The stream tells what the batch rule tells, null hashes included."""
    from riskloom.streaming import changes

    r = random.Random(7)
    events = [(i, f"p{r.randrange(60)}", r.choice(["created", "modified", None]), START + timedelta(seconds=r.randrange(40)), r.choice(["a", "b", None])) for i in range(600)]
    r.shuffle(events)
    write(spark, events, f"{tmp_path}/in")
    stream = changes.changed_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    got = sorted(x.event_id for x in changes.run_once(stream, f"{tmp_path}/out").collect())
    assert got == sorted(x.event_id for x in changes.changed_batch(spark.createDataFrame(events, SCHEMA)).collect())
