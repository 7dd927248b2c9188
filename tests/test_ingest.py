"""Feeds, warm audiences, what other systems send, typed events."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.durations import SpecError
from tracewell.operators import cohort, crm, ingest, live, warm
from tracewell.sources.fact_store import FactStore
from tracewell.sources.model import Model
from tracewell.streaming.feed import LiveFeed


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_live_feed_of_a_rate_source(spark, tmp_path):
    sent = []

    def send(rows, dropped):
        sent.append((len(rows), dropped, [r["id"] for r in rows]))
        return len(sent) != 2  # nobody watches the second batch

    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 30).option("numPartitions", 3).load()
    rows = stream.select(F.col("value").alias("id"), F.lit("mail.clicked").alias("type"), F.lit(7).alias("passport_id"), F.timestamp_seconds("value").alias("occurred_at"), F.lit('{"event": "a\\n b"}').alias("meta"))
    feed = LiveFeed(spark, str(tmp_path / "totals"), send, most=20)
    query = feed.start(live.classify(rows, spark) if False else rows, str(tmp_path / "state"), every="50 milliseconds").start()
    try:
        while len(sent) < 4 and query.exception() is None:
            query.awaitTermination(1)
    finally:
        query.stop()
    total = feed.totals().first()
    assert total["received"] == total["sent"] + total["dropped"] + total["unwatched"] and total["received"] % 30 == 0 and total["received"] >= 90
    assert sent[0] == (20, 10, list(range(20))) and total["unwatched"] == 20
    feed.batch(spark.range(0).select("id", F.lit(None).cast("timestamp").alias("occurred_at")), 999)
    assert feed.totals().first() == total


@pytest.fixture
def shop(spark):
    events = [(k, p, day(d), "web", "conversion", None, None, None, json.dumps({"event": "buy"})) for k, (p, d) in enumerate([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3), (1, 11), (1, 12), (2, 11), (4, 11), (4, 12)])]
    schema = "id long, passport_id long, ts timestamp, channel string, direction string, source string, dwell_ms long, content_id string, meta string"
    facts = spark.createDataFrame([], "id long, passport_id long, key string, value string, type string, num double, at timestamp, observed_at timestamp")
    rows = spark.createDataFrame(events, schema)
    world = lambda until: cohort.World(spark.createDataFrame([(p,) for p in range(1, 7)], "id long"), rows.filter(F.col("ts") < day(until)), facts, str(day(until)))
    return rows, world


TWO = {"metric": {"attrs": {"event": "buy"}, "count": {"gte": 2, "lte": 3}}}


def test_warm_audiences_are_those_of_full_tests(spark, shop, tmp_path):
    rows, world = shop
    store = FactStore(spark, str(tmp_path / "store"), buckets=2)
    assert warm.sweep(store, "two", world(10), TWO, batch=0)
    people = lambda: sorted(r[0] for r in warm.members(store, "two").collect())
    assert people() == [1, 3]
    touched = rows.filter(F.col("ts").between(day(10), day(20))).select("passport_id")
    assert warm.refresh(store, "two", world(20), TWO, touched, batch=1) and not warm.refresh(store, "two", world(20), TWO, touched, batch=1)
    assert people() == [2, 3, 4] == sorted(r["passport_id"] for r in cohort.evaluate(world(20), TWO).collect())
    assert sorted((r["passport_id"], r["change"], r["at"].day) for r in warm.changes(store, "two").collect()) == [(1, "entered", 11), (1, "left", 21), (2, "entered", 21), (3, "entered", 11), (4, "entered", 21)]
    before = store.state()["n"]
    warm.sweep(store, "two", world(20), TWO)
    assert store.log().count() == 5 and store.state()["n"] == before + 1
    warm.sweep(store, "not_two", world(20), {"not": TWO})
    assert [r["passport_id"] for r in warm.entered_at(store, ["two", "not_two"], "all").collect()] == []
    assert sorted(r["passport_id"] for r in warm.entered_at(store, ["two", "not_two"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert warm.entered_at(store, []).count() == 0
    with pytest.raises(SpecError):
        warm.entered_at(store, ["two"], "some")


def test_audiences_that_hang_on_the_clock_are_swept(spark, shop, tmp_path):
    rows, world = shop
    store = FactStore(spark, str(tmp_path / "store"))
    node = {"metric": {"last": "5d", "count": {"gte": 1}}}
    assert warm.hangs_on_clock(node) and warm.hangs_on_clock({"all": [{"not": {"metric": {"recency_days": {"gte": 1}}}}]}) and not warm.hangs_on_clock(TWO)
    warm.sweep(store, "recent", world(4), node)
    warm.refresh(store, "recent", world(13), node, rows.limit(0).select("passport_id"))
    assert sorted(r[0] for r in warm.members(store, "recent").collect()) == [1, 2, 4]


HELD = "passport_id long, ts timestamp, channel string, direction string, source string, content_id string, text string, meta string, plugin string"
SENT = "passport_id long, source string, event string, external_id string, text string, ts timestamp, direction string, attrs map<string,string>, replace string"


def test_events_replace_what_their_source_sent_before(spark):
    old = lambda who, source, content, plugin="crm": (who, day(0), "crm", "expression", source, content, "old", "{}", plugin)
    held = spark.createDataFrame([old(1, "g", "g:service:1"), old(1, "g", "g:service:2"), old(1, "g", "g:stay:1"), old(1, "h", "g:service:1"), old(2, "g", "g:service:1"), old(1, "g", "g:service:9", "web"), old(1, "g", None), old(3, "g", "g:service:1")], HELD)
    sent = [(1, "g", "cut", "g:service:2", None, day(1), None, {"event": "x", "place": "a_b"}, "g:service:"), (1, "g", "dye", "g:service:5", "Dyed", day(2), "conversion", None, "g:service:"), (1, "g", None, "g:service:6", None, day(1), None, None, "g:service:"), (2, "g", "cut", "g:service:7", None, day(1), None, None, None), (3, "g", None, None, None, None, None, None, "g:service:")]
    incoming = spark.createDataFrame(sent, SENT)
    once = crm.ingest_events(held, incoming)
    rows = lambda df: sorted((r["passport_id"], r["source"], r["content_id"] or "", r["text"], r["direction"], r["plugin"]) for r in df.collect())
    assert rows(once) == [
        (1, "g", "", "old", "expression", "crm"), (1, "g", "g:service:2", "cut", "expression", "crm"), (1, "g", "g:service:5", "Dyed", "conversion", "crm"), (1, "g", "g:service:9", "old", "expression", "web"),
        (1, "g", "g:stay:1", "old", "expression", "crm"), (1, "h", "g:service:1", "old", "expression", "crm"), (2, "g", "g:service:1", "old", "expression", "crm"), (2, "g", "g:service:7", "cut", "expression", "crm"), (3, "g", "g:service:1", "old", "expression", "crm"),
    ]
    assert rows(crm.ingest_events(once, incoming.filter("replace IS NOT NULL"))) == rows(once)
    assert {r["meta"] for r in once.filter("content_id = 'g:service:2'").collect()} == {'{"event":"cut","place":"a_b"}'}
    plan = crm.ingest_events(held, incoming)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_notes_and_observations(spark):
    rows = spark.createDataFrame([(1, "g", "call", 7, "Called", day(1), "deal", 5), (1, "g", "call", 8, None, day(1), None, None), (2, None, "seen", 9, "Saw it", None, None, None)], "passport_id long, source string, kind string, id long, body string, ts timestamp, ref_kind string, ref_id long")
    made = {r["content_id"]: r for r in crm.notes(rows).collect()}
    assert set(made) == {"g:fact:call:7", "fact:seen:9"} and json.loads(made["g:fact:call:7"]["meta"]) == {"kind": "call", "ref": {"kind": "deal", "external_id": "5", "entity": "deal:5"}}
    seen = {r["content_id"]: r for r in crm.observations(rows).collect()}
    assert set(seen) == {"g:obs:call:7", "client:obs:seen:9"} and json.loads(seen["client:obs:seen:9"]["meta"]) == {"kind": "seen", "client": True} and seen["client:obs:seen:9"]["ts"] is not None
    both = crm.notes(rows).unionByName(crm.observations(rows)).withColumn("created_at", F.lit("2026-01-05").cast("timestamp"))
    assert crm.note_stats(both, "2026-01-01").first().asDict() == {"notes": 2, "observations": 2} and crm.note_stats(both, "2026-02-01").first()["notes"] == 0
    known = crm.claims_of(spark.createDataFrame([(1, "g", "A@X.org", "0881 100 003", 5), (2, "g", None, "12", None)], "row int, source string, email string, phone string, external_id int"), "359")
    assert sorted(tuple(r) for r in known.collect()) == [(1, "email", "address", "a@x.org"), (1, "phone", "e164", "+359881100003"), (1, "user", "g", "g:5")]


def test_typed_events_and_rejects(spark):
    good = {"events": [{"type": "engagement.text", "text": "Read", "length_chars": 40, "partial": True, "level": None}, {"kind": "video", "data": {"src": "https://x.org/v", "total_watched_s": 1.5, "duration_s": 3}}, {"type": "engagement.link", "text": "Go", "href": "/a"}]}
    bad = {"events": [{"type": "engagement.text", "text": "", "length_chars": -1}, {"type": "engagement.smell"}, {"type": "engagement.text", "text": 5, "partial": "yes", "url": "no url", "level": 7}, {"kind": "video", "data": {"muted": 1}}, {"kind": "image", "data": {"width": 1.5, "ts": [1], "kind": "video"}}, {"type": "engagement.section", "text": "t", "meta": []}]}
    rows = [json.dumps(good), json.dumps(bad), "{", json.dumps({"events": []}), json.dumps({"event": 1}), None, json.dumps({"events": [{"type": "engagement.link", "text": "x"}] * 501})]
    df = crm.parsed(spark.createDataFrame(list(enumerate(rows)), "row int, payload string"))
    got = {}
    for r in df.orderBy("row", "place").collect():
        got.setdefault(r["row"], []).append(r)
    assert [(r["kind"], r["text"], r["length_chars"], r["partial"], r["total_watched_s"], r["duration_s"], r["href"], r["reject"]) for r in got[0]] == [("text", "Read", 40, True, None, None, None, None), ("video", None, None, None, 1.5, 3.0, None, None), ("link", "Go", None, None, None, None, "/a", None)]
    assert [r["reject"] for r in got[1]] == ["text,length_chars", "kind", "text,level,url,partial", "muted,src", "kind,width,ts", "meta"]
    assert [[r["reject"] for r in got[k]] for k in range(2, 7)] == [["no JSON"], ["number of events"], ["no events"], ["no JSON"], ["number of events"]]


def test_embedding_is_tried_again_with_longer_pauses(spark):
    """One content fails five times and is given up, one comes through at its third call, copies are one call."""
    chunks = spark.createDataFrame([("a", "alpha"), ("a", "alpha"), ("b", "beta"), ("c", "gamma"), ("d", " \n"), ("e", None)], "content_hash string, chunk_text string")
    held = spark.createDataFrame([("c",)], "content_hash string")
    tries = spark.createDataFrame([], ingest.TRIES)
    clock, calls, pauses = day(0), [], []
    for _ in range(9):
        now = F.lit(clock)
        due = ingest.to_embed(chunks, held, tries, now)
        calls.append(sorted(r["content_hash"] for r in due.collect()))
        later = len([c for c in calls if "b" in c]) > 2

        def embedder(texts, later=later):
            if "alpha" in texts or not later:
                raise OSError("down")
            return [[1.0, 2.0] for _ in texts]

        got = [tuple(r) for r in ingest.embed(due, embedder).collect()]
        results = spark.createDataFrame(got, "content_hash string, embedding array<double>, failed string")
        held = held.union(results.filter("failed IS NULL").select("content_hash"))
        state = [tuple(r) for r in ingest.tries_after(tries, results, now).collect()]
        tries = spark.createDataFrame(state, ingest.TRIES)
        pauses += [(s[2] - clock).total_seconds() for s in state if s[0] == "a" and s[2] is not None and "a" in calls[-1]]
        clock = max([clock + dt.timedelta(seconds=1), *[s[2] for s in state if s[2] is not None]])
    assert calls == [["a", "b"], ["a", "b"], ["a", "b"], ["a"], ["a"], [], [], [], []] and pauses == [5, 10, 20, 40]
    assert state == [("a", 5, None, "OSError: down")] and sorted(r[0] for r in held.collect()) == ["b", "c"]


def test_embedding_fails_text_by_text(spark):
    due = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 9)], "content_hash string, chunk_text string").coalesce(1)

    def embedder(texts):
        if any(len(t) == 3 for t in texts):
            raise ValueError("three")
        return [[len(t)] for t in texts][: 1 if len(texts) == 1 else None if len(texts[0]) != 5 else 2]

    got = {r["content_hash"]: (r["embedding"], r["failed"]) for r in ingest.embed(due, embedder, lot=4).collect()}
    assert got == {**{str(i): ([float(i)], None) for i in range(1, 9)}, "3": (None, "ValueError: three")}
    early = ingest.tries_after(spark.createDataFrame([("k", 2, day(1), "old")], ingest.TRIES), spark.createDataFrame([], "content_hash string, failed string"), F.lit(day(5)))
    assert [tuple(r) for r in early.collect()] == [("k", 2, day(1), "old")]


def test_digests_are_made_before_the_join(spark):
    """A query of digests alone joins no texts."""
    plan = Model(spark, "/root/testdata/sf0.001").chunks.select("content_hash")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert [k > join for k, line in enumerate(plan) if "sha2" in line] == [True] and not any("sha2" in line or "text" in line for line in plan[:join])
