"""The written fact log and its current values."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.functions.durations import SpecError
from tracewell.operators import composition
from tracewell.operators import facts as fact_ops
from tracewell.sources import fact_store
from tracewell.sources.fact_store import FactStore

ROW = "passport_id long, key string, value string, observed_at timestamp, external_id string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], ROW)


@pytest.fixture
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "facts"), buckets=3)


def values(df):
    return sorted((r["passport_id"], r["key"], r["value"]) for r in df.collect())


def test_batches_and_replays(spark, store):
    rng = random.Random(4)
    made = []
    for batch in range(4):
        rows = [(rng.randrange(12), rng.choice(["plan", "city/x", "7"]), str(rng.randrange(4)), day(rng.randrange(40))) for _ in range(25)]
        made += rows
        assert store.record(rows_of(spark, rows), batch=batch, stream="s", force=True)
        before = store.state()
        assert not store.record(rows_of(spark, rows), batch=batch, stream="s", force=True)
        assert store.state() == before
    assert values(store.log()) == sorted((p, k, v) for p, k, v, _ in made)
    want = store.log().groupBy("passport_id", "key").agg(F.max_by("value", F.struct("observed_at", "id")).alias("value"))
    assert values(store.current()) == values(want) and store.drift().isEmpty()
    for key in ("plan", "city/x", "7"):
        assert values(store.current(key)) == values(fact_ops.current(store.log(key), key).withColumn("key", F.lit(key)))
        as_of = fact_ops.current(store.log(key), key, as_of="2026-01-20").select("passport_id", "value")
        assert sorted(map(tuple, as_of.collect())) == sorted(map(tuple, fact_ops.current(store.log(), key, as_of="2026-01-20").select("passport_id", "value").collect()))
    assert composition.breakdown(store.current("plan"), "plan").collect() == composition.breakdown(store.log(), "plan").collect()
    assert store.record(rows_of(spark, [(1, "plan", "9", day(90))]), batch=0, stream="another", force=True)


def test_only_touched_buckets_are_written_anew_and_reads_are_pruned(spark, store):
    store.record(rows_of(spark, [(p, k, "a", day(0)) for p in range(30) for k in ("x", "y")]))
    store.record(rows_of(spark, [(5, "x", "b", day(1))]))
    versions = store.state()["current"]
    assert set(versions["y"].values()) == {1} and sorted(versions["x"].values()) == [1, 1, 2]
    read = store.current("x").inputFiles() + store.log("x").inputFiles()
    assert all("/key=x/" in f for f in read) and {f.split("/v=")[1][0] for f in read} == {"1", "2"}
    assert ("x", "b") in [(k, v) for p, k, v in values(store.current("x")) if p == 5] and store.current("x").count() == 30
    assert store.vacuum() == 0
    store.record(rows_of(spark, [(p, k, "c", day(2)) for p in range(30) for k in ("x", "y")]))
    assert store.vacuum() == 2 and store.current().count() == 60 and store.log().count() == 121


def test_restatements(spark, store):
    store.record(rows_of(spark, [(1, "at", '{"lat": 1, "in": {"b": [{"y": 2, "x": 1}], "a": null}}', day(1)), (2, "n", "5", day(1))]))
    again = [(1, "at", '{"in": {"a": null, "b": [{"x": 1, "y": 2}]}, "lat": 1}', day(2)), (2, "n", "5", day(0)), (2, "n", "5", day(3), "booking:1"), (3, "n", "5", day(1))]
    store.record(rows_of(spark, again))
    assert values(store.log()) == [(1, "at", '{"lat": 1, "in": {"b": [{"y": 2, "x": 1}], "a": null}}'), (2, "n", "5"), (2, "n", "5"), (2, "n", "5"), (3, "n", "5")]
    other_order = [(1, "at", '{"lat": 1, "in": {"b": [{"y": 2, "x": 1}, 1], "a": null}}', day(2))]
    store.record(rows_of(spark, other_order))
    assert store.log("at").count() == 2
    store.record(rows_of(spark, [(2, "n", "5", day(9))]), force=True)
    assert store.log("n").count() == 5


def test_external_ids(spark, store):
    store.record(rows_of(spark, [(1, "b", "open", day(1), "x1"), (2, "b", "open", day(1), "x2")]))
    with pytest.raises(PySparkException, match="external_id"):
        store.record(rows_of(spark, [(1, "b", "paid", day(2), "x1")]))
    assert store.log().count() == 2
    store.record(rows_of(spark, [(1, "b", "paid", day(2), "x1"), (3, "b", "open", day(1), "x3")]), resolve="skip")
    assert values(store.current()) == [(1, "b", "open"), (2, "b", "open"), (3, "b", "open")]
    store.record(rows_of(spark, [(1, "b", "lost", day(0), "x1"), (2, "b", "old", day(0))]), resolve="replace")
    assert values(store.current()) == [(1, "b", "lost"), (2, "b", "open"), (3, "b", "open")] and store.drift().isEmpty()
    store.record(rows_of(spark, [(1, "b", "won", day(0), "x1")]), resolve="replace")
    assert values(store.log()) == [(1, "b", "won"), (2, "b", "old"), (2, "b", "open"), (3, "b", "open")]
    with pytest.raises(SpecError):
        store.record(rows_of(spark, []), resolve="merge")


def test_a_write_that_fails_leaves_nothing(spark, store, monkeypatch):
    store.record(rows_of(spark, [(1, "k", "a", day(0))]), batch=0)
    monkeypatch.setattr(store, "_commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.record(rows_of(spark, [(1, "k", "wrong", day(1)), (2, "j", "wrong", day(1))]), batch=1)
    monkeypatch.undo()
    assert values(store.current()) == values(store.log()) == [(1, "k", "a")]
    assert store.record(rows_of(spark, [(1, "k", "b", day(1))]), batch=1)
    assert values(store.current()) == [(1, "k", "b")] and values(store.log()) == [(1, "k", "a"), (1, "k", "b")]
    with pytest.raises(PySparkException, match="no passport_id"):
        store.record(rows_of(spark, [(None, "k", "a", day(0))]))
    other = FactStore(spark, store.folder, buckets=3)
    monkeypatch.setattr(other, "state", lambda: {"n": 1, "streams": {}, "log": [1], "current": {}})
    with pytest.raises(RuntimeError, match="somebody else"):
        other.record(rows_of(spark, [(1, "k", "b", day(1))]))


def test_merges_and_erasure_reach_the_current_values(spark, store):
    merges = spark.createDataFrame([(1, 2)], "absorbed long, survivor long")
    store.record(rows_of(spark, [(1, "k", "new", day(5)), (2, "k", "old", day(1)), (3, "k", "c", day(1))]))
    store.repoint(merges)
    assert values(store.current()) == [(2, "k", "new"), (3, "k", "c")] and store.log().count() == 3 and store.drift().isEmpty()
    store.record(rows_of(spark, [(1, "k", "newer", day(6))]), merges=merges)
    assert values(store.current()) == [(2, "k", "newer"), (3, "k", "c")]
    store.erase(spark.createDataFrame([(2,)], "passport_id long"))
    assert values(store.current()) == values(store.log()) == [(3, "k", "c")]
    store.rebuild()
    assert values(store.current()) == [(3, "k", "c")]


def test_one_and_many(spark, store):
    assert store.state()["n"] == 0 and store.current().count() == 0 and store.log("k").count() == 0
    store.record_one(passport_id=1, key="k", value="1.5")
    people = spark.createDataFrame([(1,), (2,), (2,), (4,)], "passport_id long")
    store.record_many(people, "tag", "vip", "2026-01-01", merges=spark.createDataFrame([(4, 2)], "absorbed long, survivor long"))
    assert values(store.log()) == [(1, "k", "1.5"), (1, "tag", "vip"), (2, "tag", "vip")]
    row = store.current("k").first()
    assert (row["num"], row["type"], row["source"]) == (1.5, "number", "unknown") and row["observed_at"] is not None


def test_stream_sink(spark, store, tmp_path):
    """The same files read by one query, and again by a query that has lost its checkpoint."""
    from tests.test_streaming import source

    parts = [[{"passport_id": 1, "key": "k", "value": v, "ts": day(d), "external_id": None}] for v, d in (("a", 3), ("late", 1), ("b", 4))]
    facts = source(spark, tmp_path, parts, "passport_id long, key string, value string, ts timestamp_ntz, external_id string").withColumnRenamed("ts", "observed_at")
    for checkpoint in ("one", "two"):
        query = store.sink(facts, str(tmp_path / checkpoint), "crm").trigger(availableNow=True).start()
        query.awaitTermination()
        assert values(store.current()) == [(1, "k", "b")] and store.log().count() == 3
    assert store.state()["streams"] == {"crm": 2}


def test_large_buckets_are_folded_in_slices_and_small_ones_whole(spark, store, monkeypatch):
    """A bucket of one key is many rows, another key's few; every passport's newest value, over two writes."""
    monkeypatch.setattr(fact_store, "_FOLDED", 40)
    for batch in range(2):
        rows = [(p, "often", str((p * 7 + d + batch) % 5), day(10 * batch + d)) for p in range(200) for d in range(4)] + [(p, "seldom", str(batch), day(batch)) for p in range(6)]
        store.record(rows_of(spark, rows), batch=batch, force=True)
        files = [x.split("/current/")[1].split("/")[1:3] for x in store.current().inputFiles()]
        assert max(files.count(x) for x in files if x[0] == "key=often") > 3 and max(files.count(x) for x in files if x[0] == "key=seldom") == 1
    assert values(store.current("often")) == sorted((p, "often", str((p * 7 + 4) % 5)) for p in range(200))
    assert values(store.current("seldom")) == [(p, "seldom", "1") for p in range(6)] and store.drift().isEmpty() and store.log().count() == 1612


def test_rows_of_known_keys_are_appended_as_they_lie(spark, store, tmp_path):
    parts = [rows_of(spark, [(p, k, str(p), day(p % 9)) for p in range(50)]).drop("key").withColumn("key", F.lit(k)) for k in ("plan", "city/x")]
    rows = parts[0].unionByName(parts[1])
    before = spark._jsc.sc().newShuffleId()
    store._append(store._shaped(rows.withColumn("id", F.col("passport_id")), 1), 1, ["plan", "city/x"])
    assert spark._jsc.sc().newShuffleId() == before + 1  # no shuffle between
    assert store.record(rows, keys=["plan", "city/x", "none"], force=True)
    other = FactStore(spark, str(tmp_path / "other"))
    other.record(rows, force=True)
    assert values(store.log()) == values(other.log()) == values(store.current()) == values(other.current()) and len(values(store.log("city/x"))) == 50
    for bad in (rows, rows_of(spark, [(1, None, "a", day(0))])):
        with pytest.raises((SpecError, PySparkException)):
            store.record(bad, keys=["plan"], force=True)
    assert store.state()["n"] == 1 and store.log().count() == 100
