"""Streaming queries against plain Python over the same events."""

from collections import defaultdict
from datetime import timedelta

import pytest

from sparkloom.plans import pipelines
from sparkloom.plans.catalog import QUERIES
from sparkloom.sources.tables import event_stream
from sparkloom.streaming import jobs


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    return sorted(rows, key=lambda r: (r.ts, r.event_id))


def by(events, key):
    out = defaultdict(list)
    for e in events:
        out[e[key]].append(e)
    return out


def seconds(a, b):
    return (b - a) / timedelta(seconds=1)


@pytest.mark.parametrize(("rate", "burst"), [(1 / 3600, 3.0), (1 / 36_000, 1.0)])
def test_token_bucket(spark, sf_dir, events, rate, burst):
    want = set()
    for user, rows in by(events, "user_id").items():
        tokens, last = burst, None
        for e in rows:
            tokens = min(burst, tokens + (seconds(last, e.ts) * rate if last else 0))
            last = e.ts
            want.add((user, e.event_id, tokens >= 1))
            tokens -= tokens >= 1
    out = pipelines._appended(jobs.token_bucket(event_stream(spark, sf_dir), rate, burst), spark)
    assert {tuple(r) for r in out.select("user_id", "event_id", "allowed").collect()} == want
    assert burst > 1 or {a for *_, a in want} == {True, False}


def test_circuit_breaker(spark, sf_dir, events):
    want = set()
    for kind, rows in by(events, "event_type").items():
        now, bad, since = "CLOSED", 0, None
        for e in rows:
            if now == "OPEN" and seconds(since, e.ts) >= 60:
                now = "HALF_OPEN"
            if now != "OPEN":
                if kind != "error":
                    now, bad = "CLOSED", 0
                else:
                    bad += 1
                    if now == "HALF_OPEN" or bad >= 3:
                        now, since = "OPEN", e.ts
            want.add((kind, e.event_id, now))
    assert {tuple(r) for r in QUERIES["z08_stream_circuit_breaker"](spark, sf_dir).select("event_type", "event_id", "state").collect()} == want


def test_token_buffer(spark, sf_dir, events):
    """Groups of four, or what an hour has gathered; at the end only what the watermark has not passed stays."""
    want = set()
    mark = events[-1].ts - timedelta(hours=1)
    for user, rows in by(events, "user_id").items():
        held = []
        for e in rows:
            held.append(e)
            if len(held) == 4 or seconds(held[0].ts, e.ts) >= 3600:
                want.add((user, tuple(x.event_id for x in held)))
                held = []
        if held and held[0].ts + timedelta(hours=1) < mark:
            want.add((user, tuple(x.event_id for x in held)))
    got = {(r.user_id, tuple(r.event_ids)) for r in QUERIES["z03_stream_token_buffer"](spark, sf_dir).collect()}
    assert got == want


def test_sessions(spark, sf_dir, events):
    gap, mark = timedelta(minutes=30), events[-1].ts - timedelta(hours=1)
    want = set()
    for user, rows in by(events, "user_id").items():
        start = last = None
        n = 0
        for e in [*rows, None]:
            if last is not None and (e is None or e.ts - last > gap or e.ts - last == gap):
                if last + gap <= mark:
                    want.add((user, start, last + gap, n))
                start, n = None, 0
            if e is not None:
                start, last, n = start or e.ts, e.ts, n + 1
    got = {(r.user_id, r.start.replace(tzinfo=None), r.end.replace(tzinfo=None), r.n) for r in QUERIES["z15_stream_sessions"](spark, sf_dir).collect()}
    assert got == want


def test_sliding_windows(spark, sf_dir, events):
    mark, want = events[-1].ts - timedelta(hours=1), defaultdict(lambda: [0, 0])
    for e in events:
        start = e.ts.replace(minute=e.ts.minute // 15 * 15, second=0, microsecond=0)
        for k in range(4):
            cell = want[start - timedelta(minutes=15 * k), e.event_type]
            cell[0] += 1
            cell[1] += e.event_type != "error"
    want = {(s, t, *n) for (s, t), n in want.items() if s + timedelta(hours=1) <= mark}
    got = {(r.start.replace(tzinfo=None), r.event_type, r.n, r.good) for r in QUERIES["z05_stream_sliding_windows"](spark, sf_dir).collect()}
    assert got == want


def test_handlers_and_reports_have_rows(spark, sf_dir):
    from sparkloom.plans import sources  # noqa: F401

    assert QUERIES["u03_job_handlers"](spark, sf_dir).count() == 3
