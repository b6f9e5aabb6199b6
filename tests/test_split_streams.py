"""Stateful streams: the same results however the events are cut into batches and frames; late rows; state that goes."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import pipelines
from sparkloom.sources.tables import event_stream, with_event_columns
from sparkloom.streaming import jobs, stateful


def stream_of(spark, folder, batches):
    """A stream of ``batches`` (lists of event rows), one file each in this order."""
    schema = spark.read.parquet(folder["like"]).schema
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder['to']}/b{k}")
        for name in os.listdir(f"{folder['to']}/b{k}"):
            os.utime(f"{folder['to']}/b{k}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return with_event_columns(read.parquet(folder["to"]))


@pytest.fixture()
def small_frames(spark, monkeypatch):
    monkeypatch.setattr(stateful, "PART_ROWS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


OPERATORS = {
    "bucket": lambda s: jobs.token_bucket(s, 1 / 36_000, 1.0),
    "breaker": lambda s: jobs.circuit_breaker(s, 2),
    "buffer": lambda s: jobs.token_buffer(s, 4, 3_600_000),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_random_batches_and_frames(spark, sf_dir, tmp_path, small_frames, name):
    rng = random.Random(name)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").limit(300).collect()
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for b in batches:
        rng.shuffle(b)
    like = f"{sf_dir}/events.parquet"
    one = stream_of(spark, {"like": like, "to": str(tmp_path / "one")}, [rng.sample(rows, len(rows))])
    several = stream_of(spark, {"like": like, "to": str(tmp_path / "several")}, batches)
    results = [sorted(map(str, pipelines._appended(OPERATORS[name](s), spark).collect())) for s in (one, several)]
    if name == "buffer":
        # What the watermark sets free between batches is in other groups of the same events only where a wait was over.
        assert sum(map(len, results)) and abs(len(results[0]) - len(results[1])) <= len(results[0]) * 0.2
    else:
        assert results[0] == results[1] and len(results[0]) == len(rows)


def test_late_rows_are_dropped_and_those_in_time_count(spark, sf_dir, tmp_path):
    like = spark.read.parquet(f"{sf_dir}/events.parquet").limit(1).collect()[0]
    make = lambda i, at: type(like)(**(like.asDict() | {"event_id": i, "user_id": 1, "ts": datetime(2024, 1, 1) + timedelta(minutes=at)}))
    batches = [[make(1, 0), make(2, 600)], [make(3, 570)], [make(4, 30), make(5, 601)]]
    stream = stream_of(spark, {"like": f"{sf_dir}/events.parquet", "to": str(tmp_path / "in")}, batches)
    got = {r.event_id: r.allowed for r in pipelines._appended(jobs.token_bucket(stream, 1 / 3600, 2.0, late="1 hour"), spark).collect()}
    assert got == {1: True, 2: True, 3: True, 5: False}, "the row nine hours late is dropped, the one half an hour late takes a token"


class Memory:
    """A map state in a dict."""

    def __init__(self):
        self.held = {}

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]


def test_frames_are_merged_part_by_part(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(stateful, "PART_ROWS", 3)
    rng = random.Random(2)
    rows = [(rng.randint(0, 50), i, bool(i % 2)) for i in range(200)]
    frames = [pd.DataFrame(rows[a : a + 17], columns=["us", "event_id", "good"]) for a in range(0, 200, 17)]
    one = stateful.InOrder()
    one.spill = Memory()
    assert list(one.ordered(iter(frames))) == sorted(rows) and not one.spill.held
    assert list(one.ordered(iter(frames[:1]))) == sorted(rows[:17]) and list(one.ordered(iter([]))) == []


def test_a_healthy_circuit_holds_no_state(spark, sf_dir):
    """State rows at the end: only circuits with failures."""
    out = jobs.circuit_breaker(event_stream(spark, sf_dir), 10_000)
    query = out.writeStream.format("noop").option("checkpointLocation", pipelines._scratch(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"])
    failing = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == "error").limit(1).count()
    assert kept <= failing
