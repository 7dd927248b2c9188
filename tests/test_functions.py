"""Durations, value operators, text functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions import durations, exprs
from tracewell.functions.durations import SpecError
from tracewell.operators import facts


@pytest.mark.parametrize(
    "start, text, sign, want",
    [
        ("2026-08-18 12:00:00", "24h", -1, "2026-08-17 12:00:00"),
        ("2026-08-18 12:00:00", "7d", -1, "2026-08-11 12:00:00"),
        ("2026-08-18 12:00:00", "2w", -1, "2026-08-04 12:00:00"),
        ("2026-08-18 12:00:00", "6M", -1, "2026-02-18 12:00:00"),
        ("2026-08-18 12:00:00", "1y", -1, "2025-08-18 12:00:00"),
        ("2026-08-18 12:00:00", "18M", -1, "2025-02-18 12:00:00"),
        ("2026-08-31 12:00:00", "6M", -1, "2026-02-28 12:00:00"),
        ("2026-03-31 12:00:00", "1M", -1, "2026-02-28 12:00:00"),
        ("2026-08-18 12:00:00", "3M", 1, "2026-11-18 12:00:00"),
    ],
)
def test_shift(spark, start, text, sign, want):
    got = spark.range(1).select(durations.shift(F.lit(start).cast("timestamp"), text, sign)).first()[0]
    assert got == dt.datetime.fromisoformat(want)


@pytest.mark.parametrize("text", ["6m", "6", "d", "", "1x"])
def test_bad_duration(text):
    with pytest.raises(SpecError):
        durations.parse(text)


@pytest.mark.parametrize(
    "value, ops, want",
    [
        ("08", {"eq": 8}, True), ("08-A", {"eq": 8}, False), ("1820", {"gte": 500}, True), ("99", {"gt": "100"}, False),
        ("gold", {"eq": "gold"}, True), ("gold", {"ne": "silver"}, True), (None, {"ne": "silver"}, False), ("Gold", {"contains": "OL"}, True),
        ("Gold", {"startsWith": "go", "endsWith": "LD"}, True), ("b", {"in": ["a", "b"]}, True), ("7", {"in": [7, 9]}, True), (None, {"present": False}, True),
        ("x", {"present": True}, True), ("2026-01-02", {"gt": "2026-01-01"}, True), ("b", {"gt": "a", "lt": "c"}, True), (None, {"eq": "x"}, False),
        ("2026-08-20", {"next": "7d"}, True), ("2026-08-20", {"last": "7d"}, False), ("2026-08-01", {"before": "2026-08-02"}, True),
    ],
)
def test_value_operators(spark, value, ops, want):
    df = spark.createDataFrame([(value,)], "value string").withColumn("num", exprs.number(F.col("value")))
    assert df.select(facts.value_predicate(ops, now="2026-08-18")).first()[0] is want


def test_unknown_operator_names_the_right_one(spark):
    with pytest.raises(SpecError, match="present"):
        facts.value_predicate({"exists": True})


def test_text_functions(spark):
    df = spark.createDataFrame([("https://a.b/c?utm=1&page=2#top", "4111 1111 1111 1111 and 123-45-6789, DE89370400440532013000, 4111111111111111111")], "u string, t string")
    row = df.select(exprs.canonical_url(F.col("u")), exprs.canonical_url_keeping(F.col("u"), ["page"]), exprs.redact(F.col("t")), exprs.mask_email(F.lit("jane@x.org")), exprs.mask_phone(F.lit("+359 88 110 0003"))).first()
    assert list(row) == ["https://a.b/c", "https://a.b/c?page=2", "[REDACTED-CC] and [REDACTED-SSN], [REDACTED-IBAN], [REDACTED-CC]", "j\u2022\u2022\u2022@x.org", "+359\u2022\u2022\u202203"]


def test_masks_show_no_more_than_they_must(spark):
    dots = "\u2022\u2022\u2022"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(exprs.mask_phone(F.lit(x))) for x in ("0881100003", "12-34", "")] == ["08" + dots + "03", dots, dots]
    assert [one(exprs.mask_email(F.lit(x))) for x in ("@x", "a@b@c", "nobody")] == ["@" + dots, "a" + dots + "@b@c", "n" + dots]
    assert [one(exprs.mask(F.lit(x))) for x in ("", "a", "ab")] == [dots, dots, "a" + dots]
    assert one(exprs.mask_identity("email", F.lit(None).cast("string"))) == ""


def test_kept_parameters(spark):
    keep = lambda u, *names: spark.range(1).select(exprs.canonical_url_keeping(F.lit(u), list(names))).first()[0]
    assert keep("/c?b=2&GCLID=1&gclid=3&a=4#x", "gclid", "b") == "/c?GCLID=1&b=2"
    assert keep("/c?z=1", "gclid") == "/c" and keep("/c", "gclid") == "/c" and keep("/c#gclid=7", "gclid") == "/c?gclid=7" and keep("/c?a=1") == "/c"


def test_phones_paths_and_keys(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(exprs.e164(F.lit(x), "359")) for x in ("0881 100 003", "+359 88 110 0003", "00359881100003", "+12", "call me")] == ["+359881100003"] * 3 + ["+12", None]
    assert one(exprs.e164(F.lit("0881100003"))) is None
    assert [one(exprs.decoded_path(F.lit(x))) for x in ("https://a.b/%C3%A9t%C3%A9?q=1", "https://a.b/", "/50%", "/a+b")] == ["/\u00e9t\u00e9", "a.b", "/50%", "/a+b"]
    assert one(F.length(exprs.feed_text(F.lit("x " * 300)))) == 200 and one(exprs.feed_text(F.lit("  \n "))) is None
    with pytest.raises(SpecError, match="contacts"):
        exprs.refuse_contact_key("Email")


def test_age_borrows_by_field(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(exprs.age("months", at("2026-01-31"), at("2026-02-28")), exprs.age("years", at("2000-02-29"), at("2026-02-28")), exprs.age("days", at("2026-01-31"), at("2026-02-28"))).first()
    assert list(row) == [0, 25, 28]


def test_chunks_pack_sentences(spark):
    text = " ".join(f"s{i} a b c." for i in range(10))
    got = spark.range(1).select(exprs.sentences_to_chunks(F.lit(text), 8)).first()[0]
    assert len(got) == 5 and " ".join(got) == text
    assert spark.range(1).select(exprs.sentences_to_chunks(F.lit(""), 8)).first()[0] == []
