"""Streams that arrive part by part: late rows, state that shrinks, restarts, batches that run twice."""

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import windows as S


def events(spark, rows):
    df = spark.createDataFrame(rows, "user string, ts string, value double")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def state(progress):
    return [(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in progress]


def test_late_rows_are_dropped_and_state_shrinks(spark):
    first = events(spark, [("a", "2024-01-01 00:10", 1.0), ("a", "2024-01-01 00:20", 2.0), ("b", "2024-01-01 01:10", 3.0), ("a", "2024-01-01 05:00", 4.0)])
    feed = S.Feed(first, "feed")
    sink = S.Sink(S.counted(feed.stream, at="ts", width="1 hour", late="1 hour", keys=["user"]), "windows")
    feed.arrive(first)
    held = state(sink.run())
    assert max(n for n, _ in held) == 3 and held[-1][0] == 1  # two of three windows went out and are forgotten
    told = lambda: sorted((r["user"], r["start"].hour, r["n"], r["total"]) for r in sink.rows().collect())
    assert told() == [("a", 0, 2, 3.0), ("b", 1, 1, 3.0)]
    feed.arrive(events(spark, [("a", "2024-01-01 00:30", 100.0), ("a", "2024-01-01 05:30", 5.0), ("c", "2024-01-01 09:00", 6.0)]))
    assert sum(d for _, d in state(sink.run())) == 1
    assert told() == [("a", 0, 2, 3.0), ("a", 5, 2, 9.0), ("b", 1, 1, 3.0)]
    assert sink.run() == [] or told() == [("a", 0, 2, 3.0), ("a", 5, 2, 9.0), ("b", 1, 1, 3.0)]  # nothing new, nothing twice


def test_streams_are_joined_within_bounds(spark):
    first = events(spark, [("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 00:50", 2.0), ("b", "2024-01-01 00:10", 1.0), ("b", "2024-01-01 03:00", 2.0)])
    feed = S.Feed(first, "feed")
    left = feed.stream.filter("value = 2").select("user", F.col("ts").alias("bought"))
    right = feed.stream.filter("value = 1").select("user", F.col("ts").alias("came"))
    sink = S.Sink(S.joined(left, right, keys=["user"], at=("bought", "came"), within="1 HOUR", late="30 minutes"), "pairs")
    for rows in (first, events(spark, [("a", "2024-01-01 06:00", 1.0), ("c", "2024-01-01 06:00", 2.0)]), events(spark, [("a", "2024-01-01 06:30", 2.0), ("b", "2024-01-01 01:00", 2.0)])):
        feed.arrive(rows)
        last = sink.run()
    assert sorted((r["user"], r["bought"].hour, r["came"].hour) for r in sink.rows().collect()) == [("a", 0, 0), ("a", 6, 6)]  # b at 01:00 came too late
    assert last[-1]["stateOperators"][0]["numRowsTotal"] < 8


def test_sessions_close_by_timers(spark):
    first = events(spark, [("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 00:20", 1.0), ("a", "2024-01-01 00:10", 1.0), ("b", "2024-01-01 00:05", 1.0)])
    feed = S.Feed(first, "feed")
    sink = S.Sink(S.closed_sessions(feed.stream.select("user", "ts"), key="user", at="ts", gap_ms=900_000, late="10 minutes"), "sessions")
    feed.arrive(first)
    sink.run()
    told = lambda: sorted((r["user"], (r["end"] - r["start"]) // 60000, r["n"]) for r in sink.rows().collect())
    assert told() == []
    feed.arrive(events(spark, [("a", "2024-01-01 00:34", 1.0), ("c", "2024-01-01 00:40", 1.0)]))  # joins a's session, closes b's
    sink.run()
    assert told() == [("b", 0, 1)]
    feed.arrive(events(spark, [("b", "2024-01-01 00:06", 1.0), ("c", "2024-01-01 02:00", 1.0)]))  # late; and time goes on
    sink.run()
    assert told() == [("a", 34, 4), ("b", 0, 1), ("c", 0, 1)]


def test_latest_survives_batches_run_twice_and_restarts(spark, monkeypatch):
    monkeypatch.setattr(S, "MERGED", 3)
    feed = S.Feed(events(spark, []), "feed")
    latest = S.Latest(feed.stream, ["user"], ["ts", "value"], "latest")
    want = {}
    for k in range(8):
        rows = [("a", f"2024-01-01 0{k}:00", float(k)), ("abcdefgh"[k], f"2024-01-01 0{9 - k}:00", 0.5)]
        for user, ts, value in rows:
            want[user] = max(want.get(user, ("", 0.0)), (ts, value))
        feed.arrive(events(spark, rows))
        if k == 4:  # the batch is written, then the query dies
            def dies(number):
                raise RuntimeError("lost")

            with pytest.raises(Exception, match="lost"):
                latest.run(dies)
        got = latest.run()
        assert {r["user"]: (r["ts"].strftime("%Y-%m-%d %H:%M"), r["value"]) for r in got.collect()} == want


def test_sessions_of_many_keys_share_states(spark):
    rows = [(u if u != "k0" else None, 60 * ((7 * k * k + 13 * j * k) % 500), 1.0) for k, u in enumerate(f"k{i}" for i in range(30)) for j in range(9)]
    arrived = spark.createDataFrame(rows, "user string, s long, value double").select("user", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s")).alias("ts"), "value")
    want = []
    for user in {r[0] for r in rows}:
        runs = []
        for s in sorted(r[1] for r in rows if r[0] == user):
            if runs and s - runs[-1][1] < 900:
                runs[-1][1:] = [s, runs[-1][2] + 1]
            else:
                runs.append([s, s, 1])
        want += [(user, b - a, n) for a, b, n in runs]
    feed = S.Feed(arrived, "feed")
    sink = S.Sink(S.closed_sessions(feed.stream.select("user", "ts"), key="user", at="ts", gap_ms=900_000, late="1 day", buckets=3), "sessions")
    feed.arrive(arrived.filter("s % 120 = 0"))
    assert sink.run()[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # three buckets and the null key's
    feed.arrive(arrived.filter("s % 120 <> 0"))
    feed.arrive(events(spark, [("later", "2024-02-01 00:00", 1.0)]))
    sink.run()
    assert sorted(map(str, ((r["user"], (r["end"] - r["start"]) // 1000, r["n"]) for r in sink.rows().collect()))) == sorted(map(str, want))
