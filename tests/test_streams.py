"""Streams with timers: releases as events, and a restart from the checkpoint."""

import random

import pandas as pd

from tessera.streaming import state


def plain(errors, n, window, hold):
    recent, until, out = {}, {}, []
    for key, s in sorted(errors, key=lambda x: x[1]):
        recent[key] = [x for x in recent.get(key, []) if x >= s - window] + [s]
        if len(recent[key]) >= n and s >= until.get(key, 0):
            until[key] = s + hold
            out.append((key, s))
    return out


def test_holds_and_releases_over_a_restart(spark, tmp_path):
    rng = random.Random(8)
    errors = sorted(((rng.randrange(4), 10**6 + rng.randrange(400_000)) for _ in range(900)), key=lambda x: x[1])
    path, root = str(tmp_path / "in"), str(tmp_path / "run")
    before = spark.conf.get(state.TIMED_STORE[0])
    spark.conf.set(*state.TIMED_STORE)
    try:
        for part in (errors[:500], errors[500:]):
            rows = spark.createDataFrame(part, "key long, s long").selectExpr("key", "s", "timestamp_seconds(s) AS ts")
            rows.coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(rows.schema).parquet(path).withWatermark("ts", "1 hour")
            out = state.drain(state.holds(stream, 4, 3600, 7200), "x", root)
    finally:
        spark.conf.set(state.TIMED_STORE[0], before)
    got = sorted(tuple(r) for r in out.select("key", "event", "s").collect())
    starts = plain(errors, 4, 3600, 7200)
    end = errors[-1][1] - 3600
    want = sorted([(k, "hold", s) for k, s in starts] + [(k, "release", s + 7200) for k, s in starts if s + 7200 <= end])
    assert got == want and len(starts) > 20


def test_alerts_over_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.choice("ab"), rng.randrange(1, 130), 1_000_000 + rng.randrange(300), i) for i in range(500)]
    path, root = str(tmp_path / "in"), str(tmp_path / "run")
    want, last = [], {}
    for part in (rows[:300], rows[300:]):
        made = spark.createDataFrame(part, "keyword long, domain string, position long, s long, seq long").selectExpr("keyword", "domain", "position", "timestamp_seconds(s) AS seen_at", "seq")
        made.coalesce(1).write.mode("append").parquet(path)
        out = state.drain_alerts(spark.readStream.schema(made.schema).parquet(path), "x", root)
        for k, d, p, _, i in sorted(part, key=lambda x: (x[3], x[4])):
            if kind := state.alert_type(p, last.get((k, d))):
                want.append((k, d, kind, last.get((k, d)), p, i))
            last[k, d] = p
    assert sorted(tuple(r) for r in out.select("keyword", "domain", "alert", "old", "new", "seq").collect()) == sorted(want) and len(want) > 100


def test_tokens_of_a_key_with_many_requests(spark, tmp_path):
    rng = random.Random(6)
    times = [10**6 + rng.randrange(200_000) for _ in range(2 * state.AT_ONCE + 5)]
    rows = spark.createDataFrame([(1, s) for s in times], "key long, s long")
    rows.write.parquet(str(tmp_path / "in"))
    got = state.drain(state.token_buckets(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5.0, 2.0), "x", str(tmp_path / "run"))
    tokens, last, want = 5.0, None, []
    for s in sorted(times):
        tokens = tokens if last is None else min(5.0, tokens + (s - last) / 60.0 * 2.0)
        last, passed = s, tokens >= 1
        want.append((1, s, passed, 0.0 if passed else (1 - tokens) / 2.0 * 60.0))
        tokens -= passed
    assert sorted(tuple(r) for r in got.select("key", "s", "passed", "wait_s").collect()) == sorted(want)
    batches = [pd.DataFrame({"s": times[i : i + 1000]}) for i in range(0, len(times), 1000)]
    assert state._times(iter(batches)).nbytes == 8 * len(times)
