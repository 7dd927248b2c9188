"""Hand-built fixtures with exact answers, and properties that must hold for any data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions.durations import SpecError
from tracewell.operators import audience, cohort, composition, facts, identity, ingest, metrics, sessions

EVENTS = "id long, passport_id long, ts timestamp, channel string, direction string, source string, content_id string, content_url string, dwell_ms long, meta string, session_id string, utm_source string"
FACTS = "id long, passport_id long, key string, value string, type string, num double, at timestamp, observed_at timestamp"


def day(text):
    return dt.datetime.fromisoformat(text)


def event(i, who, when, channel="web", meta="{}", source="video", content="purchase", url=None, session=None, utm=None):
    return (i, who, day(when), channel, "exposure", source, content, url, 250, meta, session, utm)


def fact(i, who, key, value, when, at=None):
    num = float(value) if value is not None and value.replace(".", "", 1).isdigit() else None
    return (i, who, key, value, "string", num, day(at) if at else None, day(when))


@pytest.fixture(scope="module")
def purchases(spark):
    rows = [
        event(1, 1, "2026-05-01", meta='{"value":100}'), event(2, 1, "2026-05-01", meta='{"value":50}'),
        event(3, 2, "2026-05-02", "email", meta='{"value":200}'), event(4, 2, "2026-05-02", content="pricing"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def as_map(df, key="bucket"):
    return {r[key]: r["value"] for r in df.collect()}


def test_group_counts_one_content(purchases):
    spec = {"content": {"id": "purchase"}, "count": {}}
    assert as_map(metrics.group(purchases, spec, "channel", "2026-06-11")) == {"web": 2, "email": 1}
    assert metrics.cohort_size(purchases, spec, "2026-06-11").first()[0] == 2


def test_sum_guards_text_and_keeps_zero(spark, purchases):
    assert as_map(metrics.group(purchases, {"sum": {"field": "value"}}, "channel", "2026-06-11")) == {"web": 150.0, "email": 200.0}
    assert as_map(metrics.group(purchases, {"sum": {"field": "nothing"}}, "channel", "2026-06-11")) == {"web": 0.0, "email": 0.0}
    assert as_map(metrics.group(purchases, {"avg": {"field": "nothing"}}, "channel", "2026-06-11")) == {"web": None, "email": None}


@pytest.fixture(scope="module")
def watchers(spark):
    """A booker, a browser who never books, and an old customer."""
    a, b, c = (f"https://x.y/{n}.mp4" for n in "ABC")
    rows = [(1, "2026-05-01", a), (1, "2026-05-02", a + "?utm_source=q"), (1, "2026-05-03", b), (1, "2026-05-20", a), (2, "2026-05-04", a), (2, "2026-05-05", c), (3, "2026-05-06", a)]
    events = spark.createDataFrame([event(i, who, when, url=url) for i, (who, when, url) in enumerate(rows)], EVENTS)
    log = spark.createDataFrame([fact(1, 1, "first_booked_at", "2026-05-10", "2026-05-10", "2026-05-10"), fact(2, 3, "first_booked_at", "2026-01-01", "2026-01-01", "2026-01-01")], FACTS)
    return events, log


@pytest.mark.parametrize("window, want", [({"before": {"fact": "first_booked_at"}}, 3), ({"after": {"fact": "first_booked_at"}}, 2), ({"before": {"fact": "first_booked_at"}, "missingAnchor": "only"}, 2), ({"before": {"fact": "first_booked_at"}, "missingAnchor": "include"}, 5), ({"before": {"fact": "first_booked_at"}, "within": "8d"}, 2)])
def test_windows_partition_the_whole(watchers, window, want):
    events, log = watchers
    assert metrics.apply_window(events, log, window).count() == want


def test_urls_are_canonical_on_both_sides(watchers):
    events, _ = watchers
    count = lambda content: metrics.apply_filters(events, {"content": content}, "2026-06-11").count()
    assert count({"url": "https://x.y/A.mp4#t=3"}) == 5 and count({"url": {"in": ["https://x.y/B.mp4", "https://x.y/C.mp4"]}}) == 2 and count({"prefix": "https://x.y/"}) == 7


def test_narrowing_never_raises_a_total(spark):
    rows = [event(1, 1, "2026-05-01", "web", '{"value":1}', session="s1", utm="q"), event(2, 1, "2026-05-02", "email", '{"value":2}', session="s1", utm="q"), event(3, 2, "2026-05-09", "web", '{"value":3}', session="s2"), event(4, 2, "2026-06-01", "web", '{"value":4}', session="s2"), event(5, 3, "2026-06-02", "voip", '{"value":5}', "page", session="s3", utm="m"), event(6, 3, "2026-06-02", "web", '{"value":6}', "page", session="s3", utm="m")]
    events = spark.createDataFrame(rows, EVENTS)
    narrow = [{"channel": "web"}, {"source": "page"}, {"since": "2026-05-09"}, {"attrs": {"value": {"gte": 3}}}, {"session": {"utm_source": {"present": True}}}]
    for by in ("week", "channel", "session:utm_source"):
        for agg in ({"count": {}}, {"sum": {"field": "value"}}, {"distinct_passports": {}}):
            whole = as_map(metrics.group(events, agg, by, "2026-06-11"))
            for clause in narrow:
                for k, v in as_map(metrics.group(events, {**clause, **agg}, by, "2026-06-11")).items():
                    assert v <= whole[k]


def world(spark, events, log, now, people=(1, 2, 3)):
    return cohort.World(spark.createDataFrame([(p,) for p in people], "id long"), events, log, now)


@pytest.mark.parametrize("rows, want", [([(1, "2024-05-01", "crm"), (1, "2026-07-01", "web"), (1, "2026-07-03", "crm")], [1, 1]), ([(1, "2024-05-01", "crm"), (1, "2026-07-01", "web")], [1, 0])])
def test_funnel_steps_count_only_what_comes_after(spark, rows, want):
    events = spark.createDataFrame([event(i, who, when, channel, '{"event":"booking"}' if channel == "crm" else "{}") for i, (who, when, channel) in enumerate(rows)], EVENTS)
    steps = [{"name": "visited", "filter": {"metric": {"channel": "web", "count": {"gte": 1}}}}, {"name": "booked", "filter": {"metric": {"attrs": {"event": "booking"}, "count": {"gte": 1}}}, "within": "30d"}]
    w = world(spark, events, spark.createDataFrame([], FACTS), "2026-08-01")
    assert [r["n"] for r in cohort.funnel_report(w, steps).orderBy("step").collect()] == want


def test_gap_and_advance_make_the_step(spark, watchers):
    events, log = watchers
    w = world(spark, events, log, "2026-06-11")
    steps = [{"filter": {"metric": {"channel": "web", "count": {"gte": 1}}}}, {"filter": {"metric": {"channel": "web", "count": {"gte": 1}}}, "within": "1d"}]
    first, second = (p.count() for p in cohort.funnel(w, steps))
    assert cohort.gap(w, steps, 0).count() + second == first


def test_boolean_tree(spark, watchers):
    events, log = watchers
    w = world(spark, events, log, "2026-06-11", (1, 2, 3, 4))
    ids = lambda node: sorted(r[0] for r in cohort.evaluate(w, node).select("passport_id").collect())
    booked, busy = {"fact": {"first_booked_at": {"present": True}}}, {"metric": {"count": {"gte": 2}}}
    assert ids({}) == [1, 2, 3, 4] and ids(booked) == [1, 3] and ids(busy) == [1, 2]
    assert ids({"all": [booked, busy]}) == [1] and ids({"any": [booked, busy]}) == [1, 2, 3] and ids({"not": booked}) == [2, 4]
    assert ids({"all": [busy, {"not": booked}]}) == [2] and ids({"all": [{"not": busy}]}) == [3, 4]
    assert ids({"fact": {"first_booked_at": {"present": False}}}) == [2, 4]


@pytest.mark.parametrize("node", [{"every": []}, {"all": [], "any": []}, {"metric": {"chanel": "web", "count": {}}}, {"metric": {"channel": "web"}}, {"fact": {"tier": {"exists": True}}}, {"fact": {"tier": {"changed": {}}}}, {"metric": {"count": {}, "window": {"after": "2026-01-01"}}}, {"metric": {"count": {}, "since": "last week"}}])
def test_malformed_nodes_are_errors(spark, watchers, node):
    events, log = watchers
    with pytest.raises(SpecError):
        cohort.evaluate(world(spark, events, log, "2026-06-11"), node).count()


def test_history(spark):
    log = spark.createDataFrame([fact(1, 1, "tier", "gold", "2026-01-01"), fact(2, 1, "tier", "silver", "2026-05-01"), fact(3, 1, "tier", "silver", "2026-05-02"), fact(4, 2, "tier", "gold", "2026-01-01"), fact(5, 2, "tier", None, "2026-06-01")], FACTS)
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ids = lambda ops: sorted(r[0] for r in facts.matching(log, people, "tier", ops, "2026-06-11").select("passport_id").collect())
    assert ids({"transition": {"from": "gold", "to": "silver", "last": "6M"}}) == [1] and ids({"held": "gold"}) == [1, 2] and ids({"distinct": {"gte": 2}}) == ids({"distinct": 2}) == [1]
    assert ids({"distinct": {"lte": 1}}) == [2] and ids({"held": {"last": "6M"}}) == [1, 2] and ids({"held": {"last": "30d"}}) == []
    when = {r[0]: str(r[1])[:10] for r in facts.matching(log, people, "tier", {"distinct": {"lte": 2}}, "2026-06-11").collect()}
    assert when == {1: "2026-05-02", 2: "2026-06-01"}
    assert ids({"changed": {"last": "6M"}}) == [1, 2] and ids({"present": False}) == [2, 3] and ids({"eq": "silver"}) == [1]
    assert facts.without_restatements(log.filter("passport_id = 1")).count() == 2


def test_histogram_of_a_long_tail(spark):
    values = [float(1 + i % 90) for i in range(9000)] + [250.0, 420.0, 905.0, 1338.0]
    rows = composition.histogram(spark.createDataFrame([(v,) for v in values], "v double"), most=10).collect()
    assert sum(r["value"] for r in rows) == 9004 and [r for r in rows if r["hi"] is None and r["lo"] is not None]
    assert max(r["value"] for r in rows if r["hi"] is not None) < 0.3 * 9004
    assert not [r for r in composition.histogram(spark.createDataFrame([(float(v),) for v in range(1000)], "v double")).collect() if r["hi"] is None]
    assert composition.histogram(spark.createDataFrame([], "v double")).count() == 0


def test_sessions_end_by_campaign_too(spark):
    rows = [event(1, 1, "2026-05-01T10:00", utm="a"), event(2, 1, "2026-05-01T10:10"), event(3, 1, "2026-05-01T10:20", utm="b"), event(4, 1, "2026-05-01T11:00")]
    events = spark.createDataFrame(rows, EVENTS)
    assert [r[0] for r in sessions.sessionize(events, "30 minutes").orderBy("id").select("session_seq").collect()] == [0, 0, 0, 1]
    assert [r[0] for r in sessions.sessionize(events, "30 minutes", "utm_source").orderBy("id").select("session_seq").collect()] == [0, 0, 1, 2]
    rows = [event(1, 1, "2026-05-01T10:00"), event(2, 1, "2026-05-01T10:10", utm="a"), event(3, 1, "2026-05-01T10:15", utm="a"), event(4, 1, "2026-05-01T10:45"), event(5, 1, "2026-05-01T10:50", utm="a")]
    assert [r[0] for r in sessions.sessionize(spark.createDataFrame(rows, EVENTS), "30 minutes", "utm_source").orderBy("id").select("session_seq").collect()] == [0, 1, 1, 2, 3]


def test_a_metric_within_a_tree_counts_after_the_anchor(spark):
    rows = [event(1, 1, "2026-05-01T10:00"), event(2, 1, "2026-05-02T10:00"), event(3, 2, "2026-05-01T10:00")]
    log = spark.createDataFrame([fact(1, 1, "joined", "x", "2026-05-01T20:00"), fact(2, 2, "joined", "x", "2026-05-01T20:00")], FACTS)
    w = world(spark, spark.createDataFrame(rows, EVENTS), log, "2026-06-11")
    first = {"filter": {"fact": {"joined": {"present": True}}}}
    for node in ({"metric": {"count": {"gte": 1}}}, {"all": [{"metric": {"count": {"gte": 1}}}]}, {"any": [{"metric": {"count": {"gte": 1}}}]}):
        assert [r[0] for r in cohort.funnel(w, [first, {"filter": node}])[1].collect()] == [1]


def test_plans_do_not_double(spark):
    rows = spark.createDataFrame([event(k, 1, f"2026-05-0{k}T10:00") for k in range(1, 8)], EVENTS)
    w = world(spark, rows, spark.createDataFrame([], FACTS), "2026-06-11")
    steps = [{"filter": {"metric": {"count": {"gte": 1}}}}] * 6
    plan = cohort.funnel(w, steps)[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 6
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "absorbed long, survivor long")
    closure = identity.survivors(chain)
    assert closure._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1 and {r[1] for r in closure.collect()} == {40}
    with pytest.raises(RuntimeError, match="cycle"):
        identity.survivors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "absorbed long, survivor long"))


def test_merges_audiences_and_conflicts(spark):
    closure = identity.survivors(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "absorbed long, survivor long"))
    assert {r[0]: r[1] for r in closure.collect()} == {1: 4, 2: 4, 3: 4, 9: 4}
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "passport_id long")
    assert sorted(r[0] for r in audience.combine("any", [ids(1, 2), ids(2, 3)], [ids(3)]).collect()) == [1, 2]
    assert audience.combine("all", [], [ids(1)]).count() == 0
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "key string, value string, arrival long")
    assert [facts.on_conflict(rows, p, ["key"], "arrival").first()["value"] for p in ("skip", "replace")] == ["a", "b"]
    with pytest.raises(Exception, match="conflicting"):
        facts.on_conflict(rows, "error", ["key"], "arrival").collect()


def test_about_without_a_limit_finds_everybody(spark):
    from tracewell.operators import semantic

    chunks = spark.range(2500).selectExpr("id AS doc_id", "array(1.0D, 0.0D) AS embedding")
    contacts = spark.range(2500).selectExpr("id AS passport_id", "id AS doc_id", "timestamp '2024-01-01' AS ts")
    assert [semantic.about(chunks, contacts, [1.0, 0.0], 0.2, most).count() for most in (2000, None)] == [2000, 2500]


def test_writes_that_restate_and_notes(spark):
    held = spark.createDataFrame([(1, "k", '{"a":1,"b":2}', day("2026-05-02"))], "passport_id long, key string, value string, observed_at timestamp")
    rows = [(1, "k", '{"b":2,"a":1}', day("2026-05-03"), None), (1, "k", '{"b":2,"a":1}', day("2026-05-01"), None), (1, "k", '{"a":1,"b":2}', day("2026-05-03"), "x"), (1, "k", "new", day("2026-05-03"), None), (2, "k", "v", day("2026-05-03"), None)]
    batch = spark.createDataFrame(rows, "passport_id long, key string, value string, observed_at timestamp, external_id string")
    assert sorted(str(r["observed_at"])[:10] + r["value"][:4] for r in facts.news(batch, held).collect()) == ['2026-05-01{"b"', "2026-05-03new", "2026-05-03v", '2026-05-03{"a"']
    log = spark.createDataFrame([fact(1, 1, "a", "x", "2026-01-01"), fact(2, 1, "a", "y", "2026-01-02"), fact(3, 2, "a", "y", "2026-01-02"), fact(4, 1, "b", "x", "2026-01-01")], FACTS)
    got = {r["fact"]: (r["code"], r["affected"], r["percent"], r["used"]) for r in facts.notes(log, ["a", "b"], uses={"a": "max"}).collect()}
    assert got == {"a": ("ambiguous_fact_value", 1, 50.0, "max")}
    assert facts.notes(log, ["a"], declared={"a": "min"}).count() == 0 and facts.notes(log, ["a"], declared={"a": "min"}, anchors={"a": None}).first()["used"] == "min"


def test_knowledge_of_an_empty_cohort_is_nothing(spark):
    from tracewell.operators import semantic

    chunks = spark.range(5).selectExpr("id AS doc_id", "array(1.0D, 0.0D) AS embedding")
    contacts = spark.range(5).selectExpr("id AS passport_id", "id AS doc_id", "timestamp '2024-01-01' AS ts", "id", "'web' AS channel", "CAST(NULL AS DOUBLE) AS engagement")
    nobody = spark.range(0).selectExpr("id AS passport_id")
    assert semantic.knowledge(chunks, contacts, [1.0, 0.0], cohort=nobody).count() == 0 and semantic.knowledge(chunks, contacts, [1.0, 0.0], passport_id=3).count() == 1
    with pytest.raises(ValueError, match="query"):
        semantic.knowledge(chunks, contacts, cohort=nobody)


def test_holds_over_several_slots(spark):
    t = lambda s: day("2026-05-01T" + s)
    holds = spark.createDataFrame([(1, 10, t("10:00"), t("13:30")), (1, 11, t("12:00"), t("12:30"))], "number long, visitor long, held_from timestamp, held_to timestamp")
    calls = spark.createDataFrame([(k, 1, t(x)) for k, x in enumerate(("09:59", "10:00", "12:10", "12:30", "13:29", "13:30"))], "call long, number long, ts timestamp")
    assert {r["call"]: r["visitor"] for r in audience.attributed(calls, holds).collect()} == {0: None, 1: 10, 2: 11, 3: 10, 4: 10, 5: None}


def test_identities_link_within_their_lifespan(spark):
    """Late sightings leave the holder alone, and still keep the identity alive; kinds without a lifespan merge nobody."""
    seen = [
        (1, "phone", "p", 1, day("2026-01-01")), (2, "phone", "p", 2, day("2026-03-01")), (3, "phone", "p", 3, day("2026-03-31")),
        (4, "phone", "p", 3, day("2026-04-01")), (5, "phone", "p", 4, day("2026-05-01T23:00")), (6, "user", "u", 5, day("2020-01-01")),
        (7, "user", "u", 6, day("2026-01-01")), (8, "name", "n", 7, day("2026-01-01")), (9, "name", "n", 8, day("2026-01-01")), (10, None, None, 9, None),
    ]
    rows = spark.createDataFrame(seen, "id long, type string, value string, passport_id long, seen_at timestamp")
    assert sorted((r["absorbed"], r["survivor"]) for r in identity.linked(rows).collect()) == [(1, 3), (3, 4), (5, 6)]


def test_descriptions_of_keys(spark):
    rows = [fact(i, i, "n", str(i), "2026-01-01") for i in range(1, 31)] + [fact(40 + i, i, "t", "ab"[i % 2], "2026-01-01") for i in range(3)] + [fact(50, 1, "none", None, "2026-01-01")]
    got = {r["key"]: r for r in facts.described(spark.createDataFrame(rows, FACTS)).collect()}
    assert (got["n"]["low"], got["n"]["high"], got["n"]["values"], len(got["n"]["sample"])) == ("1.0", "30.0", None, 8)
    assert (got["t"]["low"], got["t"]["high"], got["t"]["values"], got["t"]["type"]) == ("a", "b", ["a", "b"], "string")
    assert got["none"]["values"] == [] and got["none"]["low"] is None


def test_cross_tab_of_a_fact_takes_each_person_once(spark, purchases):
    held = spark.createDataFrame([fact(1, 1, "age", "10", "2026-01-01"), fact(2, 2, "age", "30", "2026-01-01")], FACTS)
    by = ("channel", "content")
    cells = metrics.cross_tab(purchases, {"avg": {"fact": "age"}}, by, "2026-06-01", held).collect()
    assert {(r["bucket"], r["series"]): r["value"] for r in cells} == {("web", "purchase"): 10.0, ("email", "purchase"): 30.0, ("web", "pricing"): 30.0}
    only = metrics.cross_tab(purchases, {"count": {}}, by, "2026-06-01", cohort=held.filter("passport_id = 1")).collect()
    assert [tuple(r) for r in only] == [("web", "purchase", 2)]
    assert tuple(metrics.cross_tab_extent(purchases, {"count": {}}, by, "2026-06-01", series_limit=1).first()) == (1, 2, True, 2)


def test_rechecks_wait_for_quiet(spark, purchases):
    rows = spark.createDataFrame([(1, day(f"2026-05-01T10:00:{s:02}")) for s in (0, 1, 2, 9)] + [(2, day("2026-05-01T10:00:00"))], "passport_id long, ts timestamp")
    got = {(r["passport_id"], r["recheck_at"].second, r["n"]) for r in ingest.rechecks(rows, "2 seconds").collect()}
    assert got == {(1, 4, 3), (1, 11, 1), (2, 2, 1)}


def test_goals_of_the_absorbed_count_for_the_survivor(spark):
    enrolled = spark.createDataFrame([(4, day("2026-01-01"))], "passport_id long, enrolled_at timestamp")
    log = spark.createDataFrame([(1, day("2026-01-20"))], "passport_id long, occurred_at timestamp")
    closure = identity.survivors(spark.createDataFrame([(1, 2), (2, 4)], "absorbed long, survivor long"))
    assert [audience.converted_within(enrolled, log, n, c).count() for n, c in ((None, None), (10, closure), (30, closure), (None, closure))] == [0, 0, 1, 1]
