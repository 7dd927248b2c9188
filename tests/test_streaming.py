"""Streams over a few files, run to their end."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.functions.durations import SpecError
from tracewell.operators import sessions
from tracewell.streaming import journeys, stateful


def run(out, path):
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{path}/out")


def source(spark, tmp_path, parts, schema):
    """Each part is a file, read one a micro-batch in order."""
    for k, rows in enumerate(parts):
        d = tmp_path / "in"
        d.mkdir(exist_ok=True)
        kinds = {"long": pa.int64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}
        fields = [x.strip().split(" ") for x in schema.split(",")]
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in fields])), d / f"{k}.parquet")
        os.utime(d / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))


def at(text):
    return dt.datetime.fromisoformat(text)


def test_duplicates_go(spark, tmp_path):
    rows = [[{"event_id": 1, "ts": at("2026-01-01")}, {"event_id": 1, "ts": at("2026-01-01")}], [{"event_id": 1, "ts": at("2026-01-01")}, {"event_id": 2, "ts": at("2026-01-01")}]]
    got = run(stateful.once_each(source(spark, tmp_path, rows, "event_id long, ts timestamp_ntz")), tmp_path)
    assert sorted(r[0] for r in got.select("event_id").collect()) == [1, 2]


def test_campaign_change_and_quiet_end_sessions(spark, tmp_path):
    e = lambda t, c: {"passport_id": 1, "ts": at(f"2026-01-01T{t}"), "campaign": c}
    rows = [[e("10:00", "a"), e("10:10", None), e("10:20", "b")], [e("11:30", None)], [{"passport_id": 2, "ts": at("2026-01-03"), "campaign": None}]]
    got = run(stateful.campaign_sessions(source(spark, tmp_path, rows, "passport_id long, ts timestamp_ntz, campaign string")), tmp_path)
    found = sorted((r["started_at"].strftime("%H:%M"), r["events"], r["reason"]) for r in got.collect())
    assert found == [("10:00", 2, "campaign"), ("10:20", 1, "inactivity"), ("11:30", 1, "inactivity")]


def test_sessions_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Events out of order within the lateness, one hour, over four files."""
    rng = random.Random(8)
    rows = [{"passport_id": rng.randrange(5), "ts": at("2026-01-01") + dt.timedelta(seconds=40 * k), "id": k, "campaign": rng.choice([None, None, "", "a", "b"])} for k in range(900)]
    rows = [r for r in rows if rng.random() < 0.12 or r["passport_id"] == 0]
    mixed = sorted(rows, key=lambda r: r["ts"] + dt.timedelta(seconds=rng.randrange(3000)))
    parts = [mixed[k * len(mixed) // 4 : (k + 1) * len(mixed) // 4] for k in range(4)]
    end = [{"passport_id": 99, "ts": at("2026-02-01"), "id": -1, "campaign": None}]
    got = run(stateful.campaign_sessions(source(spark, tmp_path, [*parts, end], "passport_id long, ts timestamp_ntz, id long, campaign string")), tmp_path)
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], "passport_id long, ts timestamp, id long, campaign string")
    want = sessions.sessions(batch, "30 minutes", "campaign")
    key = lambda df: sorted(tuple(r) for r in df.select("passport_id", "started_at", "last_activity_at", "events").collect())
    assert key(got) == key(want) and len(key(want)) > 40


PLAN = {"trigger": "signup", "start": "wait", "steps": {"wait": {"kind": "wait", "for": "2d", "next": "bought"}, "bought": {"kind": "branch", "event": "purchase", "then": "thank", "otherwise": "nudge"}, "thank": {"kind": "set_fact", "value": "customer", "next": "again"}, "again": {"kind": "wait", "for": "1d", "next": "end"}, "nudge": {"kind": "add_to_list", "value": "nudge", "next": "end"}, "end": {"kind": "exit"}}}


def test_journeys_wait_branch_and_take_late_events(spark, tmp_path):
    e = lambda who, t, kind: {"passport_id": who, "ts": at(f"2026-01-{t}"), "type": kind}
    parts = [
        [e(1, "01T10:00", "signup"), e(2, "01T10:00", "signup"), e(3, "01T10:00", "purchase")],
        [e(3, "01T10:30", "signup"), e(1, "03T09:59", "view"), e(2, "02T12:00", "signup")],
        [e(1, "03T09:40", "purchase"), e(2, "01T12:00", "purchase"), e(2, "03T10:00", "purchase"), e(2, "03T10:30", "signup")],
        [e(9, "20T00:00", "view")],
    ]
    got = run(journeys.run_journeys(source(spark, tmp_path, parts, "passport_id long, ts timestamp_ntz, type string"), PLAN), tmp_path)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["at"], r["step"])):
        found.setdefault(r["passport_id"], []).append((r["step"], r["action"], r["value"], r["at"].strftime("%dT%H:%M")))
    assert found == {
        1: [("thank", "set_fact", "customer", "03T10:00"), ("end", "exit", None, "04T10:00")],  # the purchase came late, not too late
        2: [("end", "exit", None, "03T10:00"), ("nudge", "add_to_list", "nudge", "03T10:00"), ("end", "exit", None, "05T10:30"), ("nudge", "add_to_list", "nudge", "05T10:30")],  # one of the 1st came too late
        3: [("end", "exit", None, "03T10:30"), ("nudge", "add_to_list", "nudge", "03T10:30")],
    }


def test_a_journey_in_a_circle_stops():
    plan = {"trigger": "t", "start": "a", "steps": {"a": {"kind": "set_fact", "value": 1, "next": "b"}, "b": {"kind": "set_fact", "value": 2, "next": "a"}}}
    out = []
    assert journeys.Journey(plan).event(1, None, 5, "t", out) == (None, None)
    assert len(out) == journeys.MOST_HOPS + 1 and out[-1]["action"] == "stopped"
    with pytest.raises(SpecError):
        journeys.validate({"trigger": "t", "start": "a", "steps": {"a": {"kind": "set_fact", "next": "z"}}})
    with pytest.raises(SpecError):
        journeys.validate({"trigger": "t", "start": "a", "steps": {"a": {"kind": "sing"}}})


def test_gap_sessions_and_clocks_ahead(spark, tmp_path):
    e = lambda who, t: {"passport_id": who, "ts": at(f"2026-01-01T{t}")}
    rows = [[e(1, "10:00"), e(1, "10:20")], [e(1, "11:00"), e(2, "20:00")], [e(3, "23:59")]]
    got = run(stateful.gap_sessions(source(spark, tmp_path, rows, "passport_id long, ts timestamp_ntz")), tmp_path)
    assert sorted((r["passport_id"], r["events"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    some = spark.createDataFrame([(at("2026-01-01T10:05"),), (at("2026-01-01T10:05:01"),)], "ts timestamp")
    assert [r["ts"] for r in stateful.clamped(some, now).orderBy("ts").collect()] == [at("2026-01-01T10:00"), at("2026-01-01T10:05")]


def test_late_facts_do_not_win(spark):
    schema = "passport_id long, key string, value string, observed_at timestamp, id long"
    held = spark.createDataFrame([(1, "k", "new", at("2026-02-01"), 2)], schema)
    late = spark.createDataFrame([(1, "k", "old", at("2026-01-01"), 3)], schema)
    assert stateful.current_values(late, held).first()["value"] == "new"
