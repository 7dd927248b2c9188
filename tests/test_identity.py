"""Identities in time against a one-by-one replay, and the search for people."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import identity, people

SEEN = "type string, value string, passport_id long, seen_at timestamp, id long"


def day(n, second=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n, seconds=second)


def replayed(rows, days=identity.LIFESPANS):
    """One sighting after the other: holders move with every merge."""
    above, holder, last, out = {}, {}, {}, []

    def top(x):
        while x in above:
            x = above[x]
        return x

    for kind, value, who, at, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        if kind not in days or value is None or who is None:
            continue
        key, who = (kind, value), top(who)
        if key not in holder:
            holder[key] = who
        elif top(holder[key]) != who and (days[kind] is None or (at - last[key]).total_seconds() // 86400 <= days[kind]):
            above[holder[key]] = who
            out.append((holder[key], who, at))
        last[key] = at
        for k, h in holder.items():
            holder[k] = top(h)
    return out, above


def merges_of(spark, rows, **options):
    return [tuple(r) for r in identity.linked(spark.createDataFrame(rows, SEEN), **options).collect()]


def ends_of(above):
    out = {}
    for x in above:
        y = x
        while y in above:
            y = above[y]
        out[x] = y
    return out


def agree(spark, rows, **options):
    want, above = replayed(rows, options.get("lifespans", identity.LIFESPANS))
    seen = spark.createDataFrame(rows, SEEN)
    merges = identity.linked(seen, **options)
    assert sorted(map(tuple, merges.collect())) == sorted(want)
    assert {r["absorbed"]: r["survivor"] for r in identity.survivors(merges).collect()} == ends_of(above)


def test_a_phone_that_goes_to_and_fro(spark):
    rows = [("phone", "1", p, day(k), k) for k, p in enumerate([1, 2, 1, 2, 3, 1])]
    assert sorted(merges_of(spark, rows)) == [(1, 2, day(1)), (2, 3, day(4))]
    agree(spark, rows)


def test_an_absorbed_id_shows_a_second_identity(spark):
    rows = [("email", "x", 1, day(0), 1), ("email", "x", 2, day(1), 2), ("phone", "9", 3, day(2), 3), ("phone", "9", 1, day(3), 4)]
    assert sorted(merges_of(spark, rows)) == [(1, 2, day(1)), (3, 2, day(3))]
    agree(spark, rows)


def test_lifespans(spark):
    late = [("fingerprint", "f", 1, day(0), 1), ("fingerprint", "f", 2, day(8, 1), 2), ("fingerprint", "f", 2, day(9), 3), ("user", "u", 5, day(0), 4), ("user", "u", 6, day(900), 5)]
    assert sorted(merges_of(spark, late)) == [(1, 2, day(9)), (5, 6, day(900))]
    edge = [("fingerprint", "f", 1, day(0, 5), 1), ("fingerprint", "f", 2, day(8, 4), 2)]
    assert merges_of(spark, edge) == [(1, 2, day(8, 4))]
    assert merges_of(spark, [("cookie", "c", 1, day(0), 1), ("cookie", "c", 2, day(0), 2), ("phone", None, 1, day(0), 3), ("phone", None, 2, day(0), 4), ("phone", "1", None, day(0), 5), ("phone", "1", 7, day(0), 6)]) == []
    assert merges_of(spark, []) == []


@pytest.mark.parametrize("most_edges", [500_000, 14])
def test_random_sightings(spark, most_edges):
    rng = random.Random(3)
    rows = [(rng.choice(["fingerprint", "phone", "email", "user", "weak"]), str(rng.randrange(9)), rng.randrange(40), day(rng.randrange(60), rng.randrange(3)), k) for k in range(150)]
    agree(spark, rows, most_edges=most_edges)


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 60)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in identity.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1060), 1000)}


@pytest.fixture(scope="module")
def crowd(spark):
    passports = spark.createDataFrame([("ab12", day(1)), ("ab99", day(2)), ("c0de", None), ("zz", day(3))], "id string, last_seen_at timestamp")
    identities = spark.createDataFrame([("ab12", "Ann@example.com"), ("c0de", "+359 88")], "passport_id string, value string")
    facts = spark.createDataFrame([("zz", "Example street"), ("ab99", None), ("c0de", "ab")], "passport_id string, value string")
    return passports, facts, identities


def found(crowd, *a, **options):
    return sorted(r["id"] for r in people.search(*crowd, *a, **options).collect())


def test_search(spark, crowd):
    gone = spark.createDataFrame([("ab12", "zz")], "absorbed string, survivor string")
    assert found(crowd, "EXAMPLE") == ["ab12", "zz"] and found(crowd, "example", merges=gone) == ["zz"]
    assert found(crowd, "ab") == ["ab12", "ab99", "c0de"] and found(crowd, "ab", fields="id") == ["ab12", "ab99"]
    assert found(crowd, "xyz", fields="id") == [] and found(crowd, "example", fields=("identities", "?")) == ["ab12"]
    assert found(crowd, "example", fields="nothing") == ["ab12", "zz"]
    assert found(crowd) == ["ab12", "c0de"] and found(crowd, anonymous=True) == ["ab12", "ab99", "c0de", "zz"]


def test_search_by_grams(spark, crowd, tmp_path):
    grams = people.grams_of(crowd[1].select("value").union(crowd[2].select("value")))
    grams.write.partitionBy("bucket").parquet(str(tmp_path / "grams"))
    held = spark.read.parquet(str(tmp_path / "grams"))
    for text in ("exam", "EXAMPLE", "ple s", "ab", "9 8", "streets", "eet"):
        assert found(crowd, text, grams=held) == found(crowd, text)
    assert "bucket" in str(people.holding(held, "exam")._jdf.queryExecution().executedPlan()).split("PartitionFilters: [")[1].split("]")[0]
