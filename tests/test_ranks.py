"""Percentiles by counts, pages by key, a busy person's enrolments, and refused questions."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import exprs
from tracewell.functions.durations import SpecError
from tracewell.operators import audience, composition, ingest, metrics, ranks, semantic

DAY0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("p", [0, 0.25, 0.5, 0.9, 1])
@pytest.mark.parametrize("slices", [2, 4096])
def test_percentiles(spark, p, slices):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, 2.0, rng.random() * 10**k, -5.0])) for k in range(6) for g in ("a", "b", None) for _ in range(30)]
    rows += [("one", 7.0), ("none", None), ("nan", float("nan")), ("nan", 3.0), ("wide", 1e300), ("wide", -1e300), ("same", 4.0), ("same", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["value"] for r in ranks.percentiles(df, ["g"], F.col("x"), p, slices).collect()}
    by = {}
    for g, x in rows:
        by.setdefault(g, []).extend([x] if x is not None and x == x else [])
    assert got.keys() == by.keys() and got["none"] is None
    for g, xs in by.items():
        if xs:
            assert got[g] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-4)


def test_percentiles_keep_no_group_together(spark):
    df = spark.range(2000).select(F.lit(1).alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    plan = ranks.percentiles(df, ["g"], F.col("x"), 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()
    with pytest.raises(SpecError):
        ranks.percentiles(df, ["g"], F.col("x"), 1.5)


def test_pages(spark):
    rng = random.Random(3)
    rows = [(k, DAY0 + dt.timedelta(seconds=rng.randrange(40)) if k % 9 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    want = sorted(((t, k) for k, t in rows if t), reverse=True)
    seen, after = [], None
    while True:
        got = sorted(ranks.page(df, ["ts", "id"], 64, after).collect(), key=lambda r: (r["ts"], r["id"]), reverse=True)
        seen += [(r["ts"], r["id"]) for r in got]
        after = (seen[-1][0], seen[-1][1])
        assert {r["more"] for r in got} == {len(seen) < len(want)}
        if not got[0]["more"]:
            break
    assert seen == want
    for number in (0, 1, 3, 4):
        begins = ranks.page_begins(df, ["ts", "id"], 64, number, bins=4)
        got = [(r["ts"], r["id"]) for r in ranks.page(df, ["ts", "id"], 64, begins).collect()]
        assert sorted(got, reverse=True) == want[64 * number : 64 * number + 64]
    assert ranks.page(df, ["ts", "id"], 64, ranks.page_begins(df, ["ts", "id"], 64, 9)).count() == 0
    assert ranks.page_begins(df.limit(0), ["ts", "id"], 64, 2) is None


def test_a_late_page_is_cut_by_the_scan(spark, tmp_path):
    df = spark.range(1000).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    df.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = ranks.page(rows, ["ts", "id"], 10, (DAY0, 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_enrolments_of_a_busy_person(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("passport_id"), F.timestamp_seconds(F.col("id") * 50).alias("ts"))
    began = time.time()
    got = [r["enrolled_at"] for r in ingest.enrolments(df, 1).filter("passport_id = 1").orderBy("enrolled_at").collect()]
    assert time.time() - began < 30
    want, last = [], None
    for k in range(60_000):
        if k % 10 and (last is None or k * 50 - last >= 86400):
            want.append(last := k * 50)
    assert got == want


def test_attribute_tests(spark):
    rows = [('{"n": "5", "t": "Sofia"}',), ('{"n": 5.0, "t": null}',), ('{"t": "50%"}',), (None,), ('{"n": "05", "t": "true"}',)]
    df = spark.createDataFrame([(m, k) for k, (m,) in enumerate(rows)], "meta string, id int")
    found = lambda key, ops: [r["id"] for r in df.filter(metrics._attr(df.columns, key, ops)).orderBy("id").collect()]
    assert found("n", 5) == [0] and found("n", {"eq": "05"}) == [4] and found("n", {"ne": 5}) == [1, 4]
    assert found("n", {"gte": 5}) == [0, 1, 4] and found("n", {"gte": "1"}) == [0, 1] and found("n", [5, "05"]) == [0, 4]
    assert found("t", {"present": True}) == [0, 1, 2, 4] and found("n", {"present": False}) == [2, 3] and found("t", True) == [4]
    assert found("t", {"contains": "0%"}) == [2] and found("t", {"ne": "Sofia"}) == [2, 4]
    for bad in (None, {}, {"like": 1}, {"in": "x"}):
        with pytest.raises(SpecError):
            metrics._attr(df.columns, "n", bad)


def test_contacts_are_no_dimension(spark):
    facts = spark.createDataFrame([], "id long, passport_id long, key string, value string, num double, at timestamp, observed_at timestamp")
    events = spark.createDataFrame([], "id long, passport_id long, ts timestamp, meta string")
    for ask in (lambda: composition.breakdown(facts, "email"), lambda: composition.split_by(events, facts, "Phone", ["1"], F.col("ts")), lambda: metrics.group(events, {"count": {}}, "fact:mobile", "2026-01-01", facts), lambda: metrics.group(events, {"count": {}}, "attr:email", "2026-01-01")):
        with pytest.raises(SpecError):
            ask()


def test_numbers_of_countries(spark):
    rows = [("359881100003",), ("0881 100 003",), ("+359881100003",), ("00359881100003",), ("+1 212 555 0100",), ("+7495 1234567",), ("abc",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("p", exprs.e164(F.col("t"), "359"))
    got = [(r["p"], r["c"]) for r in df.withColumn("c", exprs.calling_code(F.col("p"))).collect()]
    assert got[:4] == [("+359881100003", "+359")] * 4 and got[4:6] == [("+12125550100", "+1"), ("+74951234567", "+7")] and got[6:] == [(None, None)] * 2


def test_people_with_contacts(spark):
    passports = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    facts = spark.createDataFrame([(1, 1, "full_name", "Ann", None, None, DAY0)], "id long, passport_id long, key string, value string, num double, at timestamp, observed_at timestamp")
    identities = spark.createDataFrame([(1, "email", "ann@x.org", DAY0), (2, "phone", "+359881100003", DAY0), (2, "user", "u7", DAY0), (3, "fingerprint", "abc", DAY0), (3, "crm", "c-9", DAY0)], "passport_id long, type string, value string, last_seen_at timestamp")
    got = {r["passport_id"]: tuple(r)[1:] for r in composition.people_table(passports, facts, "full_name", identities=identities).collect()}
    dots = exprs.DOTS
    assert got == {1: (f"A{dots}", f"a{dots}@x.org", None, "Ann", "name"), 2: (None, None, f"+359{dots}03", f"+359{dots}03", "phone"), 3: (None, None, None, f"c{dots}", "crm"), 4: (None,) * 5}


def test_long_holds_lie_in_long_slots(spark):
    at = lambda h: DAY0 + dt.timedelta(hours=h)
    holds = spark.createDataFrame([(1, 10, at(0), at(24 * 365 * 3)), (1, 11, at(50), at(51)), (2, 12, at(0), at(30)), (2, 13, at(5), at(5)), (3, 14, at(0), at(24 * 365 * 40))], "number int, visitor int, held_from timestamp, held_to timestamp")
    calls = spark.createDataFrame([(1, 1, at(50.5)), (2, 1, at(9000)), (3, 2, at(29.9)), (4, 2, at(30)), (5, 2, at(5)), (6, 3, at(24 * 365 * 39)), (7, 4, at(0))], "call int, number int, ts timestamp")
    assert {r["call"]: r["visitor"] for r in audience.attributed(calls, holds).collect()} == {1: 11, 2: 10, 3: 12, 4: None, 5: 12, 6: 14, 7: None}
    spread = audience.attributed(calls, holds)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in spread


def test_echoes_of_the_type_go(spark):
    rows = [("View content — Red shoes", "conversion:view_content:1"), ("conversion view content | Red", "conversion:view_content:1"), ("Conversion view con – X – Y", "conversion:view_content:1"), ("conversion: view content", "conversion:view_content:1"), ("Red — View", "conversion:view_content:1"), ("Text", None), (None, "a:b")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, p string, c string")
    got = [r["s"] for r in df.select("k", exprs.without_type_echo(F.col("p"), F.col("c")).alias("s")).orderBy("k").collect()]
    assert got == ["View content — Red shoes", "Red", "X — Y", None, "Red — View", "Text", None]


def test_codes(spark):
    codes = [r[0] for r in spark.range(500).select(exprs.random_code(7)).collect()]
    assert len(set(codes)) == 500 and all(len(c) == 7 and set(c) <= set(exprs.CODE_SIGNS) for c in codes)


def test_judges_that_fail_pass_nobody_and_are_counted(spark):
    evidence = spark.createDataFrame([(1, "abc"), (2, "x"), (3, None), (4, "")], "passport_id long, evidence string")
    rate = lambda text: 0.9 if len(text) > 1 else 1 / 0
    assert [tuple(r) for r in semantic.judge(evidence, rate).collect()] == [(1, 0.9)]
    assert sorted((r["passport_id"], r["failed"]) for r in semantic.judged(evidence, rate).collect()) == [(1, None), (2, "ZeroDivisionError: division by zero")]
    assert semantic.projected(evidence, evidence, rate).first().asDict() == {"sampled": 4, "matches": 1, "rate": 0.25, "projected": 1, "failed": 1}


def test_a_content_is_judged_once_and_no_text_goes_to_its_contacts(spark):
    """Three people met long text 1 last, one text 2, one only a content without text; a text's bytes are in no shuffle of contacts."""
    chunks = spark.createDataFrame([(1, "a" * 20), (2, "short"), (3, None), (4, "b" * 30)], "doc_id long, chunk_text string")
    met = [(1, 4, 1), (1, 1, 2), (2, 1, 1), (2, 3, 9), (3, 2, 3), (3, 1, 3), (4, 1, 1), (4, 2, 2), (5, 3, 1), (6, 8, 1)]
    contacts = spark.createDataFrame([(p, d, DAY0 + dt.timedelta(days=at), 100 + k) for k, (p, d, at) in enumerate(met)], "passport_id long, doc_id long, ts timestamp, id long")
    calls = spark.sparkContext.accumulator(0)

    def rate(text):
        calls.add(1)
        return len(text) / 20

    found = semantic.judge_latest(chunks, contacts, rate)
    assert sorted(map(tuple, found.collect())) == [(1, 1.0), (2, 1.0), (3, 1.0)] and calls.value == 2
    by_person = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [passport_id" in x]
    assert by_person and not any("text" in x or "evidence" in x for x in by_person)
