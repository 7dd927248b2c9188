"""Registered queries over the event model, each with its SQL twin where SQL has one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import durations, exprs
from ..operators import audience, cohort, composition, crm, identity, ingest, live, metrics, people, ranks, semantic, sessions, warm
from ..operators import facts as fact_ops
from ..sources.fact_store import FactStore
from ..sources.model import EVENT_NOW, FACT_KEYS, ORDER_NOW, Model
from ..sources.session import shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

EV = """ev AS (SELECT event_id AS id, user_id AS passport_id, ts,
  CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'signup' THEN 'crm' WHEN 'purchase' THEN 'mail' ELSE 'voip' END AS channel,
  CASE event_type WHEN 'view' THEN 'exposure' WHEN 'click' THEN 'expression' WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'observation' ELSE 'conversation' END AS direction,
  CASE event_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'page' WHEN 2 THEN 'text' END AS source,
  NULLIF((event_id % 7) * 100, 0) AS dwell_ms, event_type AS a_event, value AS a_value, json_extract_string(props, '$.k') AS a_k FROM events)"""
EX = EV + """, np AS (SELECT count(*) AS n FROM pages), ex AS (SELECT ev.*, p.url, split_part(split_part(p.url, '?', 1), '#', 1) AS curl
  FROM ev CROSS JOIN np LEFT JOIN pages p ON p.page_id = ev.id % np.n)"""
VIS = EV + """, s0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY passport_id ORDER BY ts, id) >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS nw FROM ev),
  s1 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY passport_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM s0),
  vis AS (SELECT *, passport_id || '-' || seq AS session_id, CASE seq % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' WHEN 2 THEN 'newsletter' END AS utm_source FROM s1)"""
ORD = """ord AS (SELECT o_orderkey AS id, o_custkey AS passport_id, o_orderdate AS obs, o_orderstatus AS st, o_totalprice AS tot, o_orderpriority AS pri FROM orders),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY passport_id ORDER BY obs DESC, id DESC) AS rn FROM ord) WHERE rn = 1),
  h AS (SELECT *, lag(st) OVER w AS pst, lag(tot) OVER w AS ptot, row_number() OVER w AS place FROM ord WINDOW w AS (PARTITION BY passport_id ORDER BY obs, id))"""
ANCH = "anch AS (SELECT passport_id, min(ts) AS a FROM ev WHERE a_event = 'purchase' GROUP BY 1)"
DAY = "%Y-%m-%d %H:%M:%S"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def model(spark: SparkSession, sf_dir: str) -> Model:
    return Model(spark, sf_dir)


def world(spark: SparkSession, sf_dir: str, now: str = EVENT_NOW) -> cohort.World:
    m = Model(spark, sf_dir)
    return cohort.World(m.passports, m.events, m.facts, now, visits=m.visits(), exposures=None)


def _grouped(name: str, spec: dict, by: str, sql_bucket: str, sql_value: str, rows: str = "events", where: str = "TRUE", source: str = EV, table: str = "ev", limit: int | None = None, tail: str = "", **options) -> None:
    def run(spark, sf_dir):
        m = Model(spark, sf_dir)
        events = m.visits() if rows == "visits" else getattr(m, rows)
        return metrics.group(events, spec, by, EVENT_NOW, m.facts, limit=limit, **options)

    run.__name__ = name
    query(f"WITH {source} SELECT {sql_bucket} AS bucket, {sql_value} AS value FROM {table} WHERE {where} GROUP BY 1 {tail}")(run)


PURCHASES = {"attrs": {"event": "purchase"}}
BOUGHT = "a_event = 'purchase'"
_grouped("group_sum_week", {**PURCHASES, "sum": {"field": "value"}}, "week", "strftime(ts, '%G-W%V')", "round(sum(a_value), 4)", where=BOUGHT)
for grain, form in (("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d"), ("month", "%Y-%m")):
    _grouped(f"group_count_{grain}", {"count": {}}, grain, f"strftime(ts, '{form}')", "count(*)")
_grouped("group_by_channel", {"count": {}}, "channel", "channel", "count(*)")
_grouped("group_by_direction", {"direction": {"in": ["exposure", "conversion"]}, "count": {}}, "direction", "direction", "count(*)", where="direction IN ('exposure', 'conversion')")
_grouped("group_by_source", {"count": {}}, "source", "source", "count(*)")
_grouped("group_by_attr", {"sum": {"field": "value"}}, "attr:k", "a_k", "round(sum(a_value), 4)")
_grouped("group_by_session_utm", {"count": {}}, "session:utm_source", "utm_source", "count(*)", rows="visits", source=VIS, table="vis")
_grouped("group_content_url", {"count": {}}, "content_url", "curl", "count(*)", rows="exposures", source=EX, table="ex")
_grouped("agg_distinct_sessions", {"distinct_sessions": {}}, "channel", "channel", "count(DISTINCT session_id)", rows="visits", source=VIS, table="vis")
_grouped("agg_distinct_people", {"distinct_passports": {}}, "channel", "channel", "count(DISTINCT passport_id)")
_grouped("agg_sum_dwell", {"sum_dwell_ms": {}}, "channel", "channel", "CAST(coalesce(sum(dwell_ms), 0) AS BIGINT)")
for agg in ("avg", "min", "max"):
    _grouped(f"agg_{agg}", {agg: {"field": "value"}}, "channel", "channel", f"round({agg}(a_value), 4)")
_grouped("agg_median", {"median": {"field": "value"}}, "channel", "channel", "round(quantile_cont(a_value, 0.5), 4)")
_grouped("agg_p90", {"percentile": {"field": "value", "p": 0.9}}, "channel", "channel", "round(quantile_cont(a_value, 0.9), 4)")
_grouped("agg_earliest", {"earliest": {"field": "value"}}, "channel", "channel", "round(arg_min_null(a_value, row(ts, id)), 4)")
_grouped("agg_latest", {"latest": {"field": "value"}}, "channel", "channel", "round(arg_max_null(a_value, row(ts, id)), 4)")
_grouped("agg_first_seen", {"first_seen": {}}, "channel", "channel", f"strftime(min(ts), '{DAY}')")
_grouped("agg_last_seen", {"last_seen": {}}, "channel", "channel", f"strftime(max(ts), '{DAY}')")
_grouped("topn_value", {"sum": {"field": "value"}}, "attr:event", "a_event", "round(sum(a_value), 4)", limit=3, tail="ORDER BY 2 DESC NULLS LAST, 1 LIMIT 3")
_grouped("topn_recent", {"count": {}}, "day", "strftime(ts, '%Y-%m-%d')", "count(*)", limit=7, tail="ORDER BY 1 DESC LIMIT 7")
_grouped("attr_range", {"attrs": {"value": {"gte": 20, "lt": 80}}, "count": {}}, "channel", "channel", "count(*)", where="a_value >= 20 AND a_value < 80")
_grouped("attr_ne", {"attrs": {"event": {"ne": "view"}}, "count": {}}, "attr:event", "a_event", "count(*)", where="a_event <> 'view'")
_grouped("attr_in", {"attrs": {"event": {"in": ["view", "click"]}}, "count": {}}, "attr:event", "a_event", "count(*)", where="a_event IN ('view', 'click')")
_grouped("attr_contains", {"attrs": {"event": {"contains": "ic"}}, "count": {}}, "attr:event", "a_event", "count(*)", where="contains(a_event, 'ic')")
_grouped("attr_starts_ends", {"attrs": {"event": {"startsWith": "p", "endsWith": "se"}}, "count": {}}, "attr:event", "a_event", "count(*)", where="a_event LIKE 'p%se'")
_grouped("attr_present", {"attrs": {"k": {"present": True}, "nothing": {"present": False}}, "count": {}}, "channel", "channel", "count(*)", where="a_k IS NOT NULL")
_grouped("filter_source_missing", {"source": {"present": False}, "count": {}}, "channel", "channel", "count(*)", where="source IS NULL")
_grouped("filter_last", {"last": "1w", "count": {}}, "day", "strftime(ts, '%Y-%m-%d')", "count(*)", where="ts >= TIMESTAMP '2024-01-24'")
_grouped("filter_since_until", {"since": "2024-01-05", "until": "2024-01-10T12:00:00", "count": {}}, "day", "strftime(ts, '%Y-%m-%d')", "count(*)", where="ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00'")
_grouped("filter_as_of", {"asOf": "2024-01-15", "last": "1M", "count": {}}, "channel", "channel", "count(*)", where="ts <= TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2023-12-15'")
_grouped("filter_session_utm", {"session": {"utm_source": ["google", "meta"]}, "count": {}}, "channel", "channel", "count(*)", rows="visits", source=VIS, table="vis", where="utm_source IN ('google', 'meta')")
_grouped("filter_content_prefix", {"content": {"prefix": "https://"}, "count": {}}, "channel", "channel", "count(*)", rows="exposures", source=EX, table="ex", where="starts_with(curl, 'https://')")
_grouped("group_by_fact", {"count": {}}, "fact:segment", "c_mktsegment", "count(*)", source=EV + ", j AS (SELECT * FROM ev LEFT JOIN customer ON c_custkey = passport_id)", table="j")
_grouped("group_fact_band", {"distinct_passports": {}}, "fact:acctbal", "CASE WHEN c_acctbal IS NOT NULL THEN CAST(CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) + 999 AS VARCHAR) END", "count(DISTINCT passport_id)", source=EV + ", j AS (SELECT * FROM ev LEFT JOIN customer ON c_custkey = passport_id)", table="j", band=1000)
_grouped("group_fact_avg_two_level", {"avg": {"fact": "acctbal"}}, "channel", "channel", "round(avg(c_acctbal), 4)", source=EV + ", j AS (SELECT DISTINCT channel, passport_id, c_acctbal FROM ev LEFT JOIN customer ON c_custkey = passport_id)", table="j")
for name, window, where in (
    ("window_before", {"before": {"fact": "first_purchase_at"}}, "ts < a"),
    ("window_after", {"after": {"fact": "first_purchase_at"}}, "ts >= a"),
    ("window_within", {"after": {"fact": "first_purchase_at"}, "within": "7d"}, "ts >= a AND ts < a + INTERVAL 7 DAY"),
    ("window_offset", {"before": {"fact": "first_purchase_at"}, "offset": "-12h"}, "ts < a - INTERVAL 12 HOUR"),
    ("window_only", {"before": {"fact": "first_purchase_at"}, "missingAnchor": "only"}, "a IS NULL"),
    ("window_include", {"before": {"fact": "first_purchase_at"}, "missingAnchor": "include"}, "a IS NULL OR ts < a"),
    ("window_between", {"between": [{"fact": "first_purchase_at", "use": "min"}, {"fact": "first_purchase_at"}]}, "ts >= a AND ts < a"),
):
    _grouped(name, {"window": window, "count": {}}, "channel", "channel", "count(*)", where=where, source=f"{EV}, {ANCH}, j AS (SELECT ev.*, a FROM ev LEFT JOIN anch USING (passport_id))", table="j")


@query(f"WITH {EV} SELECT channel AS bucket, a_event AS series, count(*) AS value FROM ev GROUP BY 1, 2 HAVING a_event IN (SELECT a_event FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")
def group_crosstab(spark, sf_dir):
    return metrics.cross_tab(model(spark, sf_dir).events, {"count": {}}, ("channel", "attr:event"), EVENT_NOW, series_limit=3)


@query(f"""WITH {EV}, {ANCH}, j AS (SELECT ev.*, a FROM ev LEFT JOIN anch USING (passport_id))
SELECT channel AS bucket, a IS NOT NULL AS anchored, count(*) AS value, count(DISTINCT passport_id) AS people FROM j WHERE a IS NULL OR ts < a GROUP BY 1, 2""")
def group_anchor_crosstab(spark, sf_dir):
    m = model(spark, sf_dir)
    return metrics.anchor_cross_tab(m.events, {"window": {"before": {"fact": "first_purchase_at"}}, "count": {}}, "channel", EVENT_NOW, m.facts)


@query(f"WITH {EV} SELECT count(DISTINCT passport_id) AS cohort_size FROM ev WHERE {BOUGHT}")
def cohort_size(spark, sf_dir):
    return metrics.cohort_size(model(spark, sf_dir).events, {**PURCHASES, "count": {}}, EVENT_NOW)


def _stamped(df: DataFrame) -> DataFrame:
    return df.select("passport_id", F.date_format("matched_at", "yyyy-MM-dd HH:mm:ss").alias("matched_at"))


def _cohort(name: str, node: dict, sql: str, now: str = EVENT_NOW) -> None:
    def run(spark, sf_dir):
        return _stamped(cohort.evaluate(world(spark, sf_dir, now), node))

    run.__name__ = name
    query(sql)(run)


def _crossing(source: str, table: str, step: str, low: float, where: str = "TRUE") -> str:
    return f"""WITH {source}, r AS (SELECT passport_id, ts, sum({step}) OVER (PARTITION BY passport_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run,
      sum({step}) OVER (PARTITION BY passport_id) AS total FROM {table} WHERE {where})
      SELECT passport_id, strftime(min(ts), '{DAY}') AS matched_at FROM r WHERE run >= {low} AND total >= {low} GROUP BY 1"""


_cohort("gate_count", {"metric": {**PURCHASES, "count": {"gte": 5}}}, _crossing(EV, "ev", "1", 5, BOUGHT))
_cohort("gate_crossing_time", {"metric": {"channel": "web", "count": {"gte": 10}}}, _crossing(EV, "ev", "1", 10, "channel = 'web'"))
_cohort("gate_sum", {"metric": {"sum": {"field": "value", "gte": 1000}}}, _crossing(EV, "ev", "a_value", 1000))
_cohort("gate_dwell", {"metric": {"sum_dwell_ms": {"gte": 5000}}}, _crossing(EV, "ev", "coalesce(dwell_ms, 0)", 5000))
_cohort("gate_distinct_sessions", {"metric": {"distinct_sessions": {"gte": 4}}}, _crossing(VIS + ", fs AS (SELECT passport_id, session_id, arg_min(id, row(ts, id)) AS id, min(ts) AS ts FROM vis GROUP BY 1, 2)", "fs", "1", 4))
_cohort("gate_recency", {"metric": {"recency_days": {"gte": 3}}}, f"WITH {EV} SELECT passport_id, strftime(max(ts), '{DAY}') AS matched_at FROM ev GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-28'")
_cohort("gate_between", {"metric": {**PURCHASES, "count": {"gte": 3, "lte": 9}}}, f"WITH {EV}, r AS (SELECT passport_id, ts, row_number() OVER (PARTITION BY passport_id ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY passport_id) AS n FROM ev WHERE {BOUGHT}) SELECT passport_id, strftime(ts, '{DAY}') AS matched_at FROM r WHERE k = 3 AND n <= 9")

_CURRENT = f"WITH {ORD} SELECT passport_id, strftime(obs, '{DAY}') AS matched_at FROM cur WHERE "
_CUSTOMER = "SELECT c_custkey AS passport_id, '1995-01-01 00:00:00' AS matched_at FROM customer WHERE "


def fact_store(spark, sf_dir: str) -> FactStore:
    """The fact log written in three batches, and its current values; made once for the tables as they are, then read."""
    files = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    tables = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)
    known = sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in tables)
    store = FactStore(spark, f"{shared_folder(spark)}/facts-{hashlib.sha256(' '.join(known).encode()).hexdigest()[:16]}")
    if store.state()["streams"].get("import", -1) >= 2:
        return store
    log, day = model(spark, sf_dir), F.to_date("observed_at")
    for batch, rows in enumerate((log.facts.filter(day < "1995-06-01"), log.facts.filter((day >= "1995-06-01") & (day < "1999-01-01")), log.facts.filter(day >= "1999-01-01"))):
        store.record(rows, batch=batch, stream="import", force=True, keys=FACT_KEYS)
    return store


@query(_CURRENT + "st = 'F'")
def fact_eq(spark, sf_dir):
    m, held = model(spark, sf_dir), fact_store(spark, sf_dir).current("order_status")
    w = cohort.World(m.passports, m.events, held, ORDER_NOW, held=held)
    return _stamped(cohort.evaluate(w, {"fact": {"order_status": {"eq": "F"}}}))


_cohort("fact_eq_log", {"fact": {"order_status": {"eq": "F"}}}, _CURRENT + "st = 'F'", ORDER_NOW)
_cohort("fact_ne", {"fact": {"order_status": {"ne": "F"}}}, _CURRENT + "st <> 'F'", ORDER_NOW)
_cohort("fact_range", {"fact": {"acctbal": {"gte": 1000, "lt": 5000.5}}}, _CUSTOMER + "c_acctbal >= 1000 AND c_acctbal < 5000.5", ORDER_NOW)
_cohort("fact_in", {"fact": {"segment": {"in": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}}}, _CUSTOMER + "c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')", ORDER_NOW)
_cohort("fact_contains", {"fact": {"segment": {"contains": "UIld"}}}, _CUSTOMER + "contains(lower(c_mktsegment), 'uild')", ORDER_NOW)
_cohort("fact_starts_ends", {"fact": {"order_priority": {"startsWith": "1-u", "endsWith": "NT"}}}, _CURRENT + "lower(pri) LIKE '1-u%nt'", ORDER_NOW)
_cohort("fact_present_false", {"fact": {"first_purchase_at": {"present": False}}}, f"WITH {EV}, {ANCH} SELECT c_custkey AS passport_id, CAST(NULL AS VARCHAR) AS matched_at FROM customer WHERE c_custkey NOT IN (SELECT passport_id FROM anch)")
_cohort("fact_date_last", {"fact": {"first_purchase_at": {"last": "4w"}}}, f"WITH {EV}, {ANCH} SELECT passport_id, strftime(a, '{DAY}') AS matched_at FROM anch WHERE a BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-31'")
_cohort("fact_use_min", {"fact": {"order_total": {"use": "min", "lt": 2000}}}, f"WITH {ORD}, m AS (SELECT *, row_number() OVER (PARTITION BY passport_id ORDER BY tot, obs DESC, id DESC) AS k FROM ord) SELECT passport_id, strftime(obs, '{DAY}') AS matched_at FROM m WHERE k = 1 AND tot < 2000", ORDER_NOW)
_cohort("fact_use_max", {"fact": {"order_total": {"use": "max", "gte": 400000}}}, f"WITH {ORD}, m AS (SELECT *, row_number() OVER (PARTITION BY passport_id ORDER BY tot DESC, obs DESC, id DESC) AS k FROM ord) SELECT passport_id, strftime(obs, '{DAY}') AS matched_at FROM m WHERE k = 1 AND tot >= 400000", ORDER_NOW)
_cohort("fact_use_first", {"fact": {"order_status": {"use": "first", "eq": "O"}}}, f"WITH {ORD} SELECT passport_id, strftime(obs, '{DAY}') AS matched_at FROM h WHERE place = 1 AND st = 'O'", ORDER_NOW)
_RECENT = f"SELECT passport_id, strftime(max(obs), '{DAY}') AS matched_at FROM h WHERE obs BETWEEN TIMESTAMP '2000-08-02' AND TIMESTAMP '2001-08-02' AND "
_cohort("fact_changed", {"fact": {"order_status": {"changed": {"last": "12M"}}}}, f"WITH {ORD} {_RECENT} place > 1 AND st IS DISTINCT FROM pst GROUP BY 1", ORDER_NOW)
_cohort("fact_transition", {"fact": {"order_status": {"transition": {"from": "O", "to": "F", "last": "1y"}}}}, f"WITH {ORD} {_RECENT} place > 1 AND pst = 'O' AND st = 'F' GROUP BY 1", ORDER_NOW)
_cohort("fact_increased", {"fact": {"order_total": {"increased": {"last": "1y"}}}}, f"WITH {ORD} {_RECENT} place > 1 AND tot > ptot GROUP BY 1", ORDER_NOW)
_cohort("fact_decreased", {"fact": {"order_total": {"decreased": {"last": "1y"}}}}, f"WITH {ORD} {_RECENT} place > 1 AND tot < ptot GROUP BY 1", ORDER_NOW)
_cohort("fact_held", {"fact": {"order_priority": {"held": "1-URGENT"}}}, f"WITH {ORD} SELECT passport_id, strftime(max(obs), '{DAY}') AS matched_at FROM ord WHERE pri = '1-URGENT' GROUP BY 1", ORDER_NOW)
_cohort("fact_distinct", {"fact": {"order_priority": {"distinct": {"gte": 4}}}}, f"""WITH {ORD}, f AS (SELECT passport_id, pri, min(row(obs, id)) AS f, arg_min(obs, row(obs, id)) AS obs FROM ord GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY passport_id ORDER BY f) AS k FROM f) SELECT passport_id, strftime(obs, '{DAY}') AS matched_at FROM n WHERE k = 4""", ORDER_NOW)

_A = f"a AS (SELECT passport_id, ts AS t FROM (SELECT passport_id, ts, row_number() OVER (PARTITION BY passport_id ORDER BY ts, id) AS k FROM ev WHERE {BOUGHT}) WHERE k = 3)"
_B = "b AS (SELECT passport_id, ts AS t FROM (SELECT passport_id, ts, row_number() OVER (PARTITION BY passport_id ORDER BY ts, id) AS k FROM ev WHERE channel = 'web') WHERE k = 8)"
_C = "c AS (SELECT c_custkey AS passport_id, TIMESTAMP '1995-01-01' AS t FROM customer WHERE c_mktsegment = 'BUILDING')"
TREE = [{"metric": {**PURCHASES, "count": {"gte": 3}}}, {"metric": {"channel": "web", "count": {"gte": 8}}}, {"fact": {"segment": "BUILDING"}}]
_cohort("filter_all", {"all": [*TREE[:2], {"not": TREE[2]}]}, f"WITH {EV}, {_A}, {_B}, {_C} SELECT passport_id, strftime(greatest(a.t, b.t), '{DAY}') AS matched_at FROM a JOIN b USING (passport_id) WHERE passport_id NOT IN (SELECT passport_id FROM c)")
_cohort("filter_any", {"any": TREE}, f"WITH {EV}, {_A}, {_B}, {_C} SELECT passport_id, strftime(min(t), '{DAY}') AS matched_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1")
_cohort("filter_not", {"not": TREE[0]}, f"WITH {EV}, {_A} SELECT c_custkey AS passport_id, CAST(NULL AS VARCHAR) AS matched_at FROM customer WHERE c_custkey NOT IN (SELECT passport_id FROM a)")


@query("SELECT passport_id, CAST(date_part('year', age(TIMESTAMP '2001-08-02', obs)) AS BIGINT) AS years, CAST(date_part('year', age(TIMESTAMP '2001-08-02', obs)) * 12 + date_part('month', age(TIMESTAMP '2001-08-02', obs)) AS BIGINT) AS months, CAST(floor((epoch(TIMESTAMP '2001-08-02') - epoch(obs)) / 86400) AS BIGINT) AS days FROM (SELECT o_custkey AS passport_id, min(o_orderdate) AS obs FROM orders GROUP BY 1)")
def computed_age(spark, sf_dir):
    now = durations.instant(ORDER_NOW, "now")
    first = model(spark, sf_dir).facts.filter("key = 'order_status'").groupBy("passport_id").agg(F.min("observed_at").alias("at"))
    return first.select("passport_id", *[exprs.age(u, F.col("at"), now).cast("long").alias(u) for u in ("years", "months", "days")])


@query(f"WITH {ORD} SELECT passport_id, st AS value FROM (SELECT *, row_number() OVER (PARTITION BY passport_id ORDER BY obs DESC, id DESC) AS k FROM ord WHERE obs <= TIMESTAMP '1998-01-01') WHERE k = 1")
def fact_asof(spark, sf_dir):
    return fact_ops.current(fact_store(spark, sf_dir).log("order_status"), "order_status", as_of="1998-01-01").select("passport_id", "value")


@query("SELECT 'log' AS kind, (SELECT count(*) FROM orders) * 3 + (SELECT count(*) FROM customer) * 2 + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') AS n UNION ALL SELECT 'current', (SELECT count(DISTINCT o_custkey) FROM orders) * 3 + (SELECT count(*) FROM customer) * 2 + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') UNION ALL SELECT 'drift', 0")
def fact_store_extent(spark, sf_dir):
    """After a batch that comes again: rows of the log and of the current values, and where these two differ."""
    store = fact_store(spark, sf_dir)
    store.record(model(spark, sf_dir).facts, batch=1, stream="import", force=True)
    named = {"log": store.log(), "current": store.current(), "drift": store.drift()}
    counts = [rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, rows in named.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {ORD} SELECT CAST(count(*) AS BIGINT) AS kept FROM h WHERE place = 1 OR st IS DISTINCT FROM pst")
def noop_suppression(spark, sf_dir):
    rows = model(spark, sf_dir).facts.filter("key = 'order_status'")
    return fact_ops.without_restatements(rows).agg(F.count(F.lit(1)).alias("kept"))


for policy, way in (("skip", "min"), ("replace", "max")):

    def _conflict(spark, sf_dir, policy=policy):
        rows = model(spark, sf_dir).facts.filter("key = 'order_status'").select("passport_id", "observed_at", "value", "id")
        kept = fact_ops.on_conflict(rows, policy, ["passport_id", "observed_at"], "id")
        return kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))

    _conflict.__name__ = f"conflict_{policy}"
    query(f"WITH k AS (SELECT arg_{way}(o_orderstatus, o_orderkey) AS value, {way}(o_orderkey) AS id FROM orders GROUP BY o_custkey, o_orderdate) SELECT value, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM k GROUP BY 1")(_conflict)

FACT_ROWS = """f AS (SELECT 'order_status' AS key, o_custkey AS pid, o_orderstatus AS v, CAST(NULL AS DOUBLE) AS num FROM orders
  UNION ALL SELECT 'order_total', o_custkey, CAST(o_totalprice AS VARCHAR), o_totalprice FROM orders UNION ALL SELECT 'order_priority', o_custkey, o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'segment', c_custkey, c_mktsegment, NULL FROM customer UNION ALL SELECT 'acctbal', c_custkey, CAST(c_acctbal AS VARCHAR), c_acctbal FROM customer
  UNION ALL SELECT 'nation', c_custkey, n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'first_purchase_at', user_id, CAST(min(ts) AS VARCHAR), NULL FROM events WHERE event_type = 'purchase' GROUP BY user_id)"""


@query(f"WITH {FACT_ROWS}, g AS (SELECT key, pid, count(DISTINCT v) AS n FROM f GROUP BY 1, 2) SELECT key, count(*) AS people, count(*) FILTER (n > 1) AS ambiguous, max(n) AS most_values FROM g GROUP BY 1")
def fact_ambiguity(spark, sf_dir):
    return fact_ops.ambiguity(model(spark, sf_dir).facts)


@query(f"WITH {FACT_ROWS} SELECT key, count(*) AS n_rows, count(DISTINCT pid) AS people, count(DISTINCT v) AS n_values, round(min(num), 4) AS low, round(max(num), 4) AS high FROM f GROUP BY 1")
def schema_discovery(spark, sf_dir):
    return fact_ops.discovery(model(spark, sf_dir).facts)


STEPS = [{"name": "seen", "filter": {"metric": {"channel": "web", "count": {"gte": 1}}}}, {"name": "signed", "filter": {"metric": {"channel": "crm", "count": {"gte": 1}}}, "within": "7d"}, {"name": "bought", "filter": {"metric": {**PURCHASES, "count": {"gte": 1}}}, "within": "3d"}]
FUNNEL = f"""{EV}, f1 AS (SELECT passport_id, min(ts) AS a FROM ev WHERE channel = 'web' GROUP BY 1),
  f2 AS (SELECT passport_id, m AS a FROM (SELECT passport_id, f1.a AS a0, min(ts) AS m FROM ev JOIN f1 USING (passport_id) WHERE channel = 'crm' AND ts > f1.a GROUP BY 1, 2) WHERE m <= a0 + INTERVAL 7 DAY),
  f3 AS (SELECT passport_id, m AS a FROM (SELECT passport_id, f2.a AS a0, min(ts) AS m FROM ev JOIN f2 USING (passport_id) WHERE a_event = 'purchase' AND ts > f2.a GROUP BY 1, 2) WHERE m <= a0 + INTERVAL 3 DAY)"""
_COUNTS = f"WITH {FUNNEL}, n AS (SELECT 0 AS step, 'seen' AS name, count(*) AS n FROM f1 UNION ALL SELECT 1, 'signed', count(*) FROM f2 UNION ALL SELECT 2, 'bought', count(*) FROM f3)"


@query(f"{_COUNTS} SELECT step, name, n, CASE WHEN step = 0 THEN 100.0::DOUBLE ELSE round(n * 100.0::DOUBLE / lag(n) OVER (ORDER BY step), 4) END AS step_conversion, round(n * 100.0::DOUBLE / first(n) OVER (ORDER BY step), 4) AS overall FROM n")
def funnel_report(spark, sf_dir):
    return cohort.funnel_report(world(spark, sf_dir), STEPS)


@query(f"{_COUNTS} SELECT * FROM (SELECT step, name, lag(n) OVER (ORDER BY step) - n AS lost, round((lag(n) OVER (ORDER BY step) - n) * 100.0::DOUBLE / lag(n) OVER (ORDER BY step), 4) AS lost_percent FROM n) WHERE step > 0")
def funnel_dropoff(spark, sf_dir):
    return composition.dropoff(cohort.funnel_report(world(spark, sf_dir), STEPS))


@query(f"WITH {FUNNEL} SELECT passport_id, CASE WHEN TIMESTAMP '2024-01-31' > a + INTERVAL 3 DAY THEN 'dropped' ELSE 'pending' END AS status FROM f2 WHERE passport_id NOT IN (SELECT passport_id FROM f3)")
def funnel_gap_dropped(spark, sf_dir):
    return cohort.gap(world(spark, sf_dir), STEPS, 1)


@query(f"WITH {FUNNEL} SELECT count(*) AS n FROM f3 JOIN f1 USING (passport_id) WHERE f3.a <= f1.a + INTERVAL 5 DAY")
def funnel_total_within(spark, sf_dir):
    return cohort.funnel(world(spark, sf_dir), STEPS, within="5d")[-1].agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, {_A} SELECT count(*) AS n FROM a")
def projection_count(spark, sf_dir):
    return cohort.count(world(spark, sf_dir), {"filter": TREE[0]})


@query(f"WITH {ORD}, c AS (SELECT st AS bucket, count(*) AS value FROM cur GROUP BY 1) SELECT bucket, value, (SELECT count(*) FROM c) AS total_buckets FROM c WHERE bucket <> '' ORDER BY value DESC, bucket LIMIT 12")
def breakdown(spark, sf_dir):
    return composition.breakdown(fact_store(spark, sf_dir).current("order_status"), "order_status", held=True)


@query(f"WITH {ORD} SELECT b AS bucket, count(passport_id) AS value FROM (VALUES ('F'), ('O'), ('Z')) v(b) LEFT JOIN cur ON st = b GROUP BY 1")
def breakdown_values(spark, sf_dir):
    return composition.breakdown(model(spark, sf_dir).facts, "order_status", ["F", "O", "Z"])


@query("WITH e AS (SELECT unnest([-1000.0, 0.0, 2500.0, 5000.0, 7500.0]) AS lo, unnest([0.0, 2500.0, 5000.0, 7500.0, 9000.0]) AS hi), b AS (SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, (SELECT count(*) FROM customer WHERE c_acctbal >= lo AND (c_acctbal < hi OR (hi = 9000 AND c_acctbal = 9000))) AS value FROM e) SELECT * FROM b UNION ALL SELECT 9000, NULL, count(*) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0 UNION ALL SELECT NULL, -1000, count(*) FROM customer WHERE c_acctbal < -1000 HAVING count(*) > 0")
def histogram_bins(spark, sf_dir):
    return composition.histogram(composition.fact_numbers(model(spark, sf_dir).facts, "acctbal"), bins=[-1000, 0, 2500, 5000, 7500, 9000])


@query("""WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, quantile_disc(c_acctbal, 0.99) AS p, bool_and(c_acctbal = floor(c_acctbal)) AS w FROM customer),
  t AS (SELECT a, b, CASE WHEN p > a AND p - a < 0.5 * (b - a) THEN p ELSE b END AS e, w FROM r), x AS (SELECT *, (e - a) / 8 AS raw FROM t),
  y AS (SELECT *, pow(10, floor(log10(raw))) AS pw FROM x), z AS (SELECT *, pw * CASE WHEN raw / pw < 1.5 THEN 1 WHEN raw / pw < 3 THEN 2 WHEN raw / pw < 7 THEN 5 ELSE 10 END AS st FROM y),
  q AS (SELECT *, floor(a / st) * st AS f, CAST(greatest(1, ceil((e - floor(a / st) * st) / st)) AS BIGINT) AS n FROM z),
  g AS (SELECT unnest(range(n)) AS i, f, st, n FROM q), v AS (SELECT least(CAST(floor((c_acctbal - f) / st) AS BIGINT), n - 1) AS i FROM customer, q)
  SELECT CAST(round(f + g.i * st, 6) AS DOUBLE) AS lo, CAST(round(f + (g.i + 1) * st, 6) AS DOUBLE) AS hi, count(v.i) AS value FROM g LEFT JOIN v USING (i) GROUP BY f, st, g.i""")
def histogram(spark, sf_dir):
    held = fact_store(spark, sf_dir).current("acctbal")
    return composition.histogram(held.filter("num IS NOT NULL").select(F.col("num").alias("v")))


@query(f"WITH {ORD} SELECT count(*) AS n, round(corr(c_acctbal, tot), 4) AS r, round(min(c_acctbal), 4) AS x_low, round(max(c_acctbal), 4) AS x_high, round(min(tot), 4) AS y_low, round(max(tot), 4) AS y_high FROM cur JOIN customer ON c_custkey = passport_id")
def scatter_explain(spark, sf_dir):
    return composition.explain_scatter(composition.scatter(model(spark, sf_dir).facts, "acctbal", "order_total"))


@query(f"WITH {ORD} SELECT passport_id, c_acctbal AS x, tot AS y, c_mktsegment AS colour FROM cur JOIN customer ON c_custkey = passport_id ORDER BY passport_id LIMIT 2000")
def scatter(spark, sf_dir):
    return composition.scatter(model(spark, sf_dir).facts, "acctbal", "order_total", "segment", limit=2000)


for grain, number in (("week", "CAST(floor(date_diff('day', DATE '1969-12-29', CAST(ts AS DATE)) / 7) AS BIGINT)"), ("month", "CAST(year(ts) * 12 + month(ts) - 1 AS BIGINT)")):

    def _retention(spark, sf_dir, grain=grain):
        return composition.retention(model(spark, sf_dir).events, grain)

    _retention.__name__ = "retention" if grain == "week" else "retention_month"
    query(f"""WITH {EV}, d AS (SELECT DISTINCT passport_id, {number} AS p FROM ev), c AS (SELECT *, min(p) OVER (PARTITION BY passport_id) AS cohort FROM d),
      n AS (SELECT cohort, p - cohort AS period, count(*) AS people FROM c WHERE p - cohort <= 12 GROUP BY 1, 2), z AS (SELECT cohort, people AS size FROM n WHERE period = 0)
      SELECT cohort, period, people, size, round(people * 100.0::DOUBLE / size, 0) AS percent FROM n JOIN z USING (cohort)""")(_retention)


@query(f"WITH {EV} SELECT c_mktsegment AS name, strftime(ts, '%G-W%V') AS bucket, count(*) AS value FROM ev JOIN customer ON c_custkey = passport_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2")
def compare_split(spark, sf_dir):
    m = model(spark, sf_dir)
    return composition.split_by(m.events, m.facts, "segment", ["BUILDING", "MACHINERY"], exprs.bucket_of_time("week", F.col("ts")))


@query(f"WITH {EV} SELECT 'web' AS name, strftime(ts, '%Y-%m-%d') AS bucket, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE channel = 'web' GROUP BY 2 UNION ALL SELECT 'bought', strftime(ts, '%Y-%m-%d'), round(sum(a_value), 4) FROM ev WHERE {BOUGHT} GROUP BY 2")
def compare_series(spark, sf_dir):
    events = model(spark, sf_dir).events
    return composition.compare({"web": metrics.group(events, {"channel": "web", "count": {}}, "day", EVENT_NOW), "bought": metrics.group(events, {**PURCHASES, "sum": {"field": "value"}}, "day", EVENT_NOW)})


@query(f"WITH {EV}, g AS (SELECT a_event AS name, strftime(ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS value FROM ev GROUP BY 1, 2), n AS (SELECT DISTINCT name FROM g), b AS (SELECT DISTINCT bucket FROM g) SELECT name, bucket, coalesce(value, 0) AS value FROM n CROSS JOIN b LEFT JOIN g USING (name, bucket)")
def aligned_series(spark, sf_dir):
    rows = model(spark, sf_dir).events
    return composition.aligned(rows.groupBy(F.col("attr_event").alias("name"), exprs.bucket_of_time("hour", F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("value")))


@query(f"WITH {EV}, {_A}, {_B}, {_C} SELECT passport_id FROM a WHERE passport_id IN (SELECT passport_id FROM b) AND passport_id NOT IN (SELECT passport_id FROM c)")
def audience_algebra(spark, sf_dir):
    w = world(spark, sf_dir)
    a, b, c = (cohort.evaluate(w, n) for n in TREE)
    return audience.combine("all", [a, b], [c])


@query(f"WITH {EV}, {_B}, {_C} SELECT passport_id FROM (SELECT passport_id FROM b UNION SELECT passport_id FROM c)")
def audience_any(spark, sf_dir):
    w = world(spark, sf_dir)
    return audience.combine("any", [cohort.evaluate(w, n) for n in TREE[1:]], [])


@query(f"WITH {EV}, {_B} SELECT count(*) AS members, count(*) FILTER (passport_id % 7 = 0) AS suppressed, count(*) FILTER (passport_id % 7 <> 0) AS sendable FROM b")
def suppression_counts(spark, sf_dir):
    w = world(spark, sf_dir)
    return audience.suppress(cohort.evaluate(w, TREE[1]), w.passports.filter("id % 7 = 0").select(F.col("id").alias("passport_id")))


TYPED = "CASE a_event WHEN 'purchase' THEN 'conversion.purchase' WHEN 'view' THEN 'awareness.recorded' WHEN 'click' THEN 'mail.clicked' WHEN 'error' THEN 'mail.failed' ELSE 'session.started' END"
CLASSED = f"{EV}, rg AS (SELECT id, {TYPED} AS type, passport_id, ts FROM ev), cl AS (SELECT *, CASE type WHEN 'conversion.purchase' THEN 'conversion' WHEN 'awareness.recorded' THEN 'exposure' WHEN 'mail.clicked' THEN 'expression' ELSE 'observation' END AS direction, CASE type WHEN 'conversion.purchase' THEN 'conversion' WHEN 'awareness.recorded' THEN 'web' WHEN 'mail.clicked' THEN 'mail' WHEN 'mail.failed' THEN 'mail' ELSE 'web' END AS channel, CASE type WHEN 'mail.failed' THEN 'error' ELSE 'info' END AS severity FROM rg)"


def _classified(spark, sf_dir) -> DataFrame:
    return live.classify(live.registry(model(spark, sf_dir).events), spark)


@query(f"WITH {CLASSED} SELECT type, direction, channel, severity, count(*) AS n FROM cl GROUP BY ALL")
def catalog_prefix_join(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("type", "direction", "channel", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLASSED} SELECT 'channel' AS facet, channel AS name, count(*) AS n FROM cl WHERE direction IN ('exposure', 'observation') GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM cl WHERE channel NOT IN ('conversion') GROUP BY 2")
def live_facets(spark, sf_dir):
    return live.facets(_classified(spark, sf_dir), channels="-conversion", directions="exposure,observation")


@query(f"WITH {CLASSED}, b AS (SELECT unnest(range(CAST(epoch(TIMESTAMP '2024-01-10') AS BIGINT), CAST(epoch(TIMESTAMP '2024-01-11') AS BIGINT), 900)) AS bucket), c AS (SELECT CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS bucket, count(*) AS n FROM cl WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)")
def registry_series_zero_fill(spark, sf_dir):
    return live.series(_classified(spark, sf_dir), "2024-01-10", "2024-01-11", live.step_for(86400))


@query(f"WITH {EV} SELECT channel, direction, count(*) AS n, count(DISTINCT passport_id) AS people FROM ev GROUP BY 1, 2")
def base_stats(spark, sf_dir):
    return live.base_stats(model(spark, sf_dir).events)


@query(f"WITH {EV} SELECT a_event AS name, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, name LIMIT 3")
def registry_top_values(spark, sf_dir):
    return live.payload_values(live.registry(model(spark, sf_dir).events), "event", 3)


@query(f"WITH {EV} SELECT count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def registry_retention(spark, sf_dir):
    return live.retained(live.registry(model(spark, sf_dir).events), EVENT_NOW, 14).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders")
def status_counters(spark, sf_dir):
    return live.counters(model(spark, sf_dir).table("orders"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT count(*) AS total, count(*) AS n_sent_at, count(*) FILTER (l_returnflag <> 'R') AS n_delivered_at, count(*) FILTER (l_returnflag = 'A') AS n_opened_at, count(*) FILTER (l_linestatus = 'F') AS n_failed FROM lineitem")
def delivery_funnel(spark, sf_dir):
    rows = model(spark, sf_dir).table("lineitem")
    outbox = rows.select(F.col("l_shipdate").alias("sent_at"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("delivered_at"), F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("opened_at"), F.col("l_linestatus").alias("status"))
    return live.delivery(outbox, ["sent_at", "delivered_at", "opened_at"], {"failed": "F"})


@query("WITH RECURSIVE m AS (SELECT c_custkey AS absorbed, c_custkey // 10 AS survivor FROM customer WHERE c_custkey BETWEEN 1 AND 999), r AS (SELECT absorbed, survivor FROM m UNION ALL SELECT r.absorbed, m.survivor FROM r JOIN m ON m.absorbed = r.survivor) SELECT absorbed, min(survivor) AS survivor FROM r GROUP BY 1")
def merge_closure(spark, sf_dir):
    return identity.survivors(model(spark, sf_dir).merges)


@query("WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1) SELECT CASE WHEN user_id BETWEEN 1 AND 999 THEN 0 ELSE user_id END AS passport_id, count(*) AS n FROM events GROUP BY 1")
def resolved_counts(spark, sf_dir):
    m = model(spark, sf_dir)
    return identity.resolve(m.events, identity.survivors(m.merges)).groupBy("passport_id").agg(F.count(F.lit(1)).alias("n"))


for gap, name in (("30 minutes", "sessionize_gap"), ("24 hours", "sessionize_day")):

    def _sessions(spark, sf_dir, gap=gap):
        out = sessions.sessions(model(spark, sf_dir).events, gap)
        return out.select("passport_id", "session_seq", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format("last_activity_at", "yyyy-MM-dd HH:mm:ss").alias("last_activity_at"), "events")

    _sessions.__name__ = name
    query(f"WITH {VIS.replace('INTERVAL 24 HOUR', 'INTERVAL ' + gap[:-1].upper())} SELECT passport_id, seq AS session_seq, strftime(min(ts), '{DAY}') AS started_at, strftime(max(ts), '{DAY}') AS last_activity_at, count(*) AS events FROM vis GROUP BY 1, 2")(_sessions)


@query(f"""WITH {EV}, c AS (SELECT *, CASE a_k WHEN '0' THEN NULL ELSE channel END AS campaign FROM ev),
  l AS (SELECT *, lag(ts) OVER (PARTITION BY passport_id ORDER BY ts, id) AS pts FROM c),
  v AS (SELECT *, sum(CASE WHEN ts - pts >= INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY passport_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS visit FROM l),
  o AS (SELECT *, coalesce(last_value(campaign IGNORE NULLS) OVER (PARTITION BY passport_id, visit ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS opened, row_number() OVER (PARTITION BY passport_id, visit ORDER BY ts, id) AS place FROM v),
  n AS (SELECT *, CASE WHEN ts - pts >= INTERVAL 24 HOUR OR (place > 1 AND campaign IS NOT NULL AND campaign <> opened) THEN 1 ELSE 0 END AS nw FROM o),
  q AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY passport_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM n) SELECT passport_id, max(seq) + 1 AS sessions FROM q GROUP BY 1""")
def sessionize_campaign(spark, sf_dir):
    rows = model(spark, sf_dir).events.withColumn("campaign", F.when(F.col("attr_k") == "0", F.lit(None)).otherwise(F.col("channel")))
    return sessions.sessionize(rows, "24 hours", "campaign").groupBy("passport_id").agg((F.max("session_seq") + 1).alias("sessions"))


@query(f"WITH {VIS} SELECT passport_id, max(seq) + 1 AS sessions, strftime(min(ts), '{DAY}') AS first_session FROM vis GROUP BY 1")
def session_counts(spark, sf_dir):
    return model(spark, sf_dir).visits().groupBy("passport_id").agg((F.max("session_seq") + 1).alias("sessions"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_session"))


def _query_vector(m: Model) -> list[float]:
    return m.table("embeddings").filter("vec_id = 0").first()["embedding"]  # one row


def _contacts(m: Model) -> DataFrame:
    n = m.table("embeddings").count()
    engagement = F.when(F.col("source") == "text", F.col("dwell_ms") / 600.0)  # of texts only, as other sources have none
    return m.events.withColumns({"doc_id": F.col("id") % n, "engagement": engagement})


CH = "ch AS (SELECT doc_id, embedding, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM documents JOIN embeddings ON doc_id = vec_id)"
CT = f"{EV}, ne AS (SELECT count(*) AS n FROM embeddings), ct AS (SELECT ev.*, id % n AS doc_id FROM ev CROSS JOIN ne)"


@query(f"WITH {CH} SELECT doc_id, round(sim, 4) AS sim FROM ch ORDER BY ch.sim DESC, doc_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.top_k(m.chunks, _query_vector(m), 20).select("doc_id", F.round("sim", 4).alias("sim"))


@query(f"WITH {CH}, {CT}, nr AS (SELECT doc_id, sim FROM ch ORDER BY sim DESC, doc_id LIMIT 20) SELECT doc_id, count(DISTINCT passport_id) AS people, round(max(sim), 4) AS sim, strftime(max(ts), '{DAY}') AS latest FROM ct JOIN nr USING (doc_id) GROUP BY 1")
def population_recall(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.population(m.chunks, _contacts(m), _query_vector(m), 20)


@query(f"WITH {CH}, {CT} SELECT passport_id, round(max(sim), 4) AS sim, strftime(max(ts), '{DAY}') AS matched_at FROM ct JOIN ch USING (doc_id) WHERE sim >= 0.2 GROUP BY 1")
def about_gate(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.about(m.chunks, _contacts(m), _query_vector(m), 0.2, most=None).select("passport_id", F.round("sim", 4).alias("sim"), F.date_format("matched_at", "yyyy-MM-dd HH:mm:ss").alias("matched_at"))


@query(f"WITH {CH}, {CT}, o AS (SELECT doc_id, arg_max_null(CASE source WHEN 'text' THEN dwell_ms / 600.0::DOUBLE END, row(ts, id)) AS d FROM ct WHERE passport_id = 7 GROUP BY 1) SELECT doc_id, round(sim, 4) AS sim, round(sim * (0.4 + 0.6 * coalesce(d, 1)), 4) AS rank_score FROM ch JOIN o USING (doc_id) ORDER BY sim * (0.4 + 0.6 * coalesce(d, 1)) DESC, doc_id LIMIT 10")
def recall_one(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.recall(m.chunks, _contacts(m), 7, _query_vector(m), 10)


@query(f"WITH {CT} SELECT doc_id, count(DISTINCT passport_id) AS people, arg_max(channel, row(ts, id)) AS channel FROM ct GROUP BY 1 ORDER BY people DESC, doc_id LIMIT 25")
def reach_sample(spark, sf_dir):
    return semantic.reach(_contacts(model(spark, sf_dir)), 25)


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:\d[ -]*?){13,19}\b', '[REDACTED-CC]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED-SSN]', 'g'), '\b[A-Z]{2}\d{2}[A-Z0-9]{12,30}\b', '[REDACTED-IBAN]', 'g')) AS h FROM documents")
def redact_pii(spark, sf_dir):
    return model(spark, sf_dir).table("documents").select("doc_id", F.sha2(exprs.redact(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(lower(trim(source))) AS contact FROM documents")
def content_hash(spark, sf_dir):
    return model(spark, sf_dir).table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), exprs.contact_hash(F.col("source"), "email").alias("contact"))


@query("SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS plain, CASE WHEN regexp_extract(url, '[?&]((?i:page)=[^&#]*)', 1) <> '' THEN split_part(split_part(url, '?', 1), '#', 1) || '?' || regexp_extract(url, '[?&]((?i:page)=[^&#]*)', 1) ELSE split_part(split_part(url, '?', 1), '#', 1) END AS kept FROM pages")
def canonical_urls(spark, sf_dir):
    url = F.col("url")
    return model(spark, sf_dir).table("pages").select("page_id", exprs.canonical_url(url).alias("plain"), exprs.canonical_url_keeping(url, ["page"]).alias("kept"))


@query(r"""WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?\n]?\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS found, text FROM documents WHERE regexp_matches(text, '\S')),
  t AS (SELECT doc_id, CASE WHEN len(found) > 0 THEN found ELSE [regexp_replace(text, '^\s+|\s+$', '', 'g')] END AS parts FROM s),
  w AS (SELECT doc_id, parts, list_reduce(list_transform(parts, lambda x: {'k': 0, 'n': len(regexp_extract_all(x, '\S+')), 'at': []::INT[]}),
    lambda a, x: CASE WHEN len(a.at) > 0 AND a.n + x.n > 200 THEN {'k': a.k + 1, 'n': x.n, 'at': list_append(a.at, a.k + 1)} ELSE {'k': a.k, 'n': a.n + x.n, 'at': list_append(a.at, a.k)} END, {'k': 0, 'n': 0::BIGINT, 'at': []::INT[]}) AS z FROM t),
  u AS (SELECT doc_id, unnest(parts) AS part, unnest(z.at) AS chunk_index, unnest(range(len(parts))) AS i FROM w)
  SELECT doc_id, chunk_index, regexp_replace(string_agg(part, ' ' ORDER BY i), '^\s+|\s+$', '', 'g') AS chunk_text FROM u GROUP BY 1, 2""")
def chunk_text(spark, sf_dir):
    docs = model(spark, sf_dir).table("documents")
    return docs.select("doc_id", F.posexplode(exprs.sentences_to_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@query(f"WITH {CT}, e AS (SELECT passport_id, arg_max(text, row(ts, id)) AS evidence FROM ct JOIN documents USING (doc_id) WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1) SELECT passport_id, least(1.0::DOUBLE, length(evidence) / 2000.0::DOUBLE) AS confidence FROM e WHERE length(evidence) >= 1400")
def judge_stub(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.judge_latest(m.chunks, _contacts(m), lambda text: min(1.0, len(text) / 2000))


@query(f"WITH {EV} SELECT c_custkey AS passport_id FROM customer WHERE c_custkey IN (SELECT passport_id FROM ev WHERE a_event = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12')")
def interval_semi_join(spark, sf_dir):
    m = model(spark, sf_dir)
    enrolled = m.passports.select(F.col("id").alias("passport_id"), F.lit("2024-01-05").cast("timestamp").alias("enrolled_at"))
    bought = live.registry(m.events).filter("type = 'conversion.purchase'")
    return audience.converted_within(enrolled, bought, 7).select("passport_id")


@query(f"WITH {EV} SELECT id, channel, strftime(ts, '{DAY}') AS ts FROM ev WHERE channel IN ('web', 'crm') ORDER BY ev.ts DESC, id DESC LIMIT 50 OFFSET 25")
def timeline_page(spark, sf_dir):
    rows = metrics.apply_filters(model(spark, sf_dir).events, {"channel": ["web", "crm"]}, EVENT_NOW)
    page = rows.orderBy(F.desc("ts"), F.desc("id")).offset(25).limit(50)
    return page.select("id", "channel", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---- ingest, joins of the plugins, and what the pages of people show ---------------------------------


@query("WITH e AS (SELECT event_id // 3 AS event_id, event_type AS name, user_id, CASE WHEN event_id % 50 = 0 THEN TIMESTAMP '2024-03-01' ELSE ts END AS ts, event_id AS received FROM events), f AS (SELECT event_id, arg_min(name, received) AS name, arg_min(ts, received) AS ts FROM e GROUP BY 1) SELECT event_id, name, strftime(CASE WHEN ts > TIMESTAMP '2024-01-31' + INTERVAL 5 MINUTE THEN TIMESTAMP '2024-01-31' ELSE ts END, '%Y-%m-%d %H:%M:%S') AS ts FROM f")
def conversion_ingest(spark, sf_dir):
    rows = model(spark, sf_dir).events.select(F.floor(F.col("id") / 3).alias("event_id"), F.col("attr_event").alias("name"), "passport_id", F.when(F.col("id") % 50 == 0, F.lit("2024-03-01").cast("timestamp")).otherwise(F.col("ts")).alias("ts"), F.col("attr_value").alias("value"), F.col("id").alias("received"))
    out = ingest.conversions(rows, durations.instant(EVENT_NOW, "now"))
    return out.select("event_id", "name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'text' ELSE 'link' END AS source, count(*) AS n, round(avg(least(1.0, CASE event_id % 4 WHEN 0 THEN value / 200.0 WHEN 1 THEN floor(greatest(0.02::DOUBLE, least(1, greatest(1, round((event_id % 700) / 5.0::DOUBLE)) * CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END / 80)) * 100 + 0.5) / 100 ELSE 1.0 END)), 6) AS engagement FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def engagement_ingest(spark, sf_dir):
    i = F.col("id") % 4
    rows = model(spark, sf_dir).events.select("id", "passport_id", "ts", F.when(i == 0, "video").when(i == 1, "text").when(i == 2, "link").otherwise("smell").alias("kind"), ((F.col("id") % 7) * 100).alias("dwell_ms"), (F.col("id") % 700).alias("length_chars"), (F.col("id") % 3 == 0).alias("partial"), F.col("attr_value").alias("watched_s"), F.lit(200.0).alias("length_s"))
    return ingest.engagement(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("engagement"), 6).alias("engagement"))


@query("SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT 'c_name' AS key, c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) WHERE value IS NOT NULL GROUP BY 1")
def records_to_facts(spark, sf_dir):
    rows = model(spark, sf_dir).table("customer").withColumn("seen", F.lit("2024-01-01"))
    return ingest.records_to_facts(rows, "c_custkey", "seen", ["c_name", "c_mktsegment", "c_nationkey"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query("SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2")
def json_unnest(spark, sf_dir):
    return ingest.unnested(model(spark, sf_dir).table("events"), "props").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, cl AS (SELECT id AS token, passport_id AS visitor, ts AS clicked_at FROM ev WHERE a_event = 'click'), cm AS (SELECT id - 1 AS token, passport_id, ts AS claimed_at FROM ev) SELECT token, visitor, cm.passport_id FROM cl JOIN cm USING (token) WHERE claimed_at >= clicked_at AND claimed_at <= clicked_at + INTERVAL 10080 MINUTE")
def link_claims(spark, sf_dir):
    events = model(spark, sf_dir).events
    clicks = events.filter("attr_event = 'click'").select(F.col("id").alias("token"), F.col("passport_id").alias("visitor"), F.col("ts").alias("clicked_at"))
    claims = events.select((F.col("id") - 1).alias("token"), "passport_id", F.col("ts").alias("claimed_at"))
    return ingest.claimed(clicks, claims, 10080)


@query(f"WITH RECURSIVE {EV}, t AS (SELECT DISTINCT passport_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM ev WHERE {BOUGHT}), r AS (SELECT passport_id, min(t) AS t FROM t GROUP BY 1 UNION ALL SELECT r.passport_id, (SELECT min(t.t) FROM t WHERE t.passport_id = r.passport_id AND t.t >= r.t + 604800) FROM r WHERE r.t IS NOT NULL) SELECT passport_id, t AS enrolled_at FROM r WHERE t IS NOT NULL")
def enrolment_cooldown(spark, sf_dir):
    return ingest.enrolments(model(spark, sf_dir).events.filter("attr_event = 'purchase'"), 7)


@query("WITH r AS (SELECT l_orderkey, arg_max(l_returnflag, row(l_shipdate, l_linenumber, l_returnflag)) AS step FROM lineitem GROUP BY 1) SELECT step, count(*) AS n FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1")
def latest_step_run(spark, sf_dir):
    m = model(spark, sf_dir)
    runs = m.table("lineitem").select(F.col("l_orderkey").alias("enrolment_id"), F.col("l_returnflag").alias("step"), F.col("l_shipdate").alias("started_at"), F.col("l_linenumber").alias("run_id"))
    enrolled = m.table("orders").select(F.col("o_orderkey").alias("enrolment_id"))
    return ingest.latest_step(enrolled, runs).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VIS} SELECT coalesce(utm_source, 'direct') AS source, count(DISTINCT session_id) AS sessions, count(DISTINCT passport_id) AS people FROM vis GROUP BY 1")
def utm_breakdown(spark, sf_dir):
    return ingest.utm_breakdown(model(spark, sf_dir).visits())


@query(f"WITH {ORD}, c AS (SELECT * FROM cur WHERE passport_id = 7) SELECT 'order_status' AS key, st AS value FROM c UNION ALL SELECT 'order_priority', pri FROM c UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def latest_of_each_key(spark, sf_dir):
    rows = model(spark, sf_dir).facts.filter(F.col("key").isin("order_status", "order_priority", "segment", "nation"))
    return ingest.latest_of_each_key(rows, 7)


@query(f"WITH {ORD}, p AS (SELECT passport_id, CASE WHEN passport_id % 10 = 3 THEN 'X' ELSE st END AS value FROM cur WHERE passport_id % 11 <> 5) SELECT passport_id, value, st AS expected FROM p FULL JOIN cur USING (passport_id) WHERE value IS DISTINCT FROM st")
def projection_audit(spark, sf_dir):
    log = model(spark, sf_dir).facts
    held = fact_ops.current(log, "order_status").filter("passport_id % 11 <> 5").select("passport_id", F.when(F.col("passport_id") % 10 == 3, "X").otherwise(F.col("value")).alias("value"))
    return fact_ops.audit(held, log, "order_status")


@query(f"WITH {EV}, h AS (SELECT passport_id % 10 AS number, passport_id AS visitor, ts AS held_from, ts + INTERVAL 60 MINUTE AS held_to FROM ev WHERE channel = 'web'), c AS (SELECT id AS call, passport_id % 10 AS number, ts FROM ev WHERE channel = 'voip') SELECT call, arg_max(visitor, held_from) AS visitor FROM c LEFT JOIN h ON h.number = c.number AND ts >= held_from AND ts < held_to GROUP BY 1")
def call_attribution(spark, sf_dir):
    events = model(spark, sf_dir).events
    holds = events.filter("channel = 'web'").select((F.col("passport_id") % 10).alias("number"), F.col("passport_id").alias("visitor"), F.col("ts").alias("held_from"), (F.col("ts") + F.expr("INTERVAL 60 MINUTE")).alias("held_to"))
    calls = events.filter("channel = 'voip'").select(F.col("id").alias("call"), (F.col("passport_id") % 10).alias("number"), "ts")
    return audience.attributed(calls, holds).select("call", "visitor")


@query(f"WITH {EV}, w AS (SELECT id AS content, id % 60 AS f FROM ev), s AS (SELECT id AS content, unnest([0, 20, 40]) AS start FROM ev) SELECT start, count(*) AS n FROM s JOIN w USING (content) WHERE start + 19 >= f AND start <= f + 15 GROUP BY 1")
def watched_segments(spark, sf_dir):
    events = model(spark, sf_dir).events
    watched = events.select(F.col("id").alias("content"), F.array(F.struct((F.col("id") % 60).alias("from"), (F.col("id") % 60 + 15).alias("to"))).alias("ranges"))
    segments = events.select(F.col("id").alias("content"), F.explode(F.array(*map(F.lit, (0, 20, 40)))).alias("start")).withColumn("end", F.col("start") + 19)
    return audience.watched_segments(segments, watched).groupBy("start").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, p AS (SELECT id, a_event, array_to_string(list(channel) OVER (PARTITION BY passport_id ORDER BY ts DESC, id DESC ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '>') AS path FROM ev) SELECT id, coalesce(path, '') AS path FROM p WHERE {BOUGHT}")
def touch_paths(spark, sf_dir):
    return ingest.touches_before(model(spark, sf_dir).events, "purchase", 3)


@query("SELECT c_custkey AS passport_id, c_mktsegment[1] || '•••' AS shown FROM customer ORDER BY 1 LIMIT 100")
def people_table(spark, sf_dir):
    m = model(spark, sf_dir)
    return composition.people_table(m.passports, m.facts, "segment")


@query(f"WITH {EV}, {_A} SELECT count(*) AS survivors, count(*) AS judge_calls, least(count(*), 20) AS sampled, count(*) > 5000 AS needs_confirmation FROM a")
def judge_preview(spark, sf_dir):
    return semantic.preview(cohort.evaluate(world(spark, sf_dir), TREE[0]))


@query("WITH v AS (SELECT CASE c_custkey % 5 WHEN 0 THEN '12.5' WHEN 1 THEN 'true' WHEN 2 THEN '2024-01-02' WHEN 3 THEN 'text' END AS v FROM customer) SELECT CASE v WHEN '12.5' THEN 'number' WHEN 'true' THEN 'bool' WHEN '2024-01-02' THEN 'date' WHEN 'text' THEN 'string' END AS kind, count(*) AS n FROM v GROUP BY 1")
def value_types(spark, sf_dir):
    i = F.col("c_custkey") % 5
    value = F.when(i == 0, "12.5").when(i == 1, "true").when(i == 2, "2024-01-02").when(i == 3, "text")
    return model(spark, sf_dir).table("customer").groupBy(exprs.value_type(value).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 3 <> 0")
def orphan_chunks(spark, sf_dir):
    m = model(spark, sf_dir)
    return identity.orphans(m.chunks.withColumn("content_hash", F.col("doc_id").cast("string")), m.chunks.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("content_hash"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c AS DOUBLE) AS v, count(*) AS people FROM (SELECT user_id, count(*) AS c FROM events GROUP BY 1) GROUP BY 1")
def event_distribution(spark, sf_dir):
    return composition.event_counts(model(spark, sf_dir).events).groupBy("v").agg(F.count(F.lit(1)).alias("people"))


@query(f"""WITH RECURSIVE w AS (SELECT epoch_ms(max(ts)) - 3600000 AS w FROM events), e AS (SELECT user_id AS p, epoch_us(ts) AS us, event_type AS kind FROM events, w WHERE epoch_ms(ts) <= w),
  r AS (SELECT p, min(us) AS us FROM e WHERE kind = 'signup' GROUP BY 1 UNION ALL SELECT r.p, (SELECT min(us) FROM e WHERE e.p = r.p AND kind = 'signup' AND e.us >= r.us + 172800000000) FROM r WHERE r.us IS NOT NULL),
  d AS (SELECT p, us + 172800000000 AS due, EXISTS (SELECT 1 FROM e WHERE e.p = r.p AND kind = 'purchase' AND e.us >= r.us AND e.us < r.us + 172800000000) AS bought FROM r, w WHERE us IS NOT NULL AND us + 172800000000 <= w * 1000)
  SELECT p AS passport_id, CASE WHEN bought THEN 'thank' ELSE 'nudge' END AS step, CASE WHEN bought THEN 'set_fact' ELSE 'add_to_list' END AS action, CASE WHEN bought THEN 'customer' ELSE 'nudge' END AS value, strftime(make_timestamp(due), '{DAY}') AS at FROM d
  UNION ALL SELECT p, 'end', 'exit', NULL, strftime(make_timestamp(due), '{DAY}') FROM d""")
def stream_journeys(spark, sf_dir):
    return _streamed(spark, sf_dir, "journeys").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, min(user_id) AS user_id, min(event_type) AS event_type FROM events GROUP BY 1")
def stream_once_each(spark, sf_dir):
    return _streamed(spark, sf_dir, "once_each")


@query(f"SELECT strftime(date_trunc('day', ts), '{DAY}') AS start, event_type AS channel, count(*) AS n FROM events WHERE epoch_ms(date_trunc('day', ts)) + 86400000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) GROUP BY 1, 2")
def stream_windowed(spark, sf_dir):
    return _streamed(spark, sf_dir, "windowed").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {VIS.replace("INTERVAL 24 HOUR", "INTERVAL 6 HOUR")}, g AS (SELECT passport_id, seq, min(ts) AS a, max(ts) AS b, count(*) AS n FROM vis WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) GROUP BY 1, 2)
  SELECT passport_id, strftime(a, '{DAY}') AS started_at, strftime(b, '{DAY}') AS last_activity_at, n AS events FROM g WHERE epoch_us(b) + 21600000000 <= (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 FROM events)""")
def stream_sessions(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _streamed(spark, sf_dir, "sessions").select("passport_id", stamp("started_at"), stamp("last_activity_at"), "events")


def _streamed(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """Run a streaming query over the events to the end of the input, and read what it wrote."""
    from ..streaming import stateful

    base = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    if what == "once_each":
        out = stateful.once_each(events).select("event_id", "user_id", "event_type")
    elif what == "journeys":
        from ..streaming import journeys

        plan = {"trigger": "signup", "start": "wait", "steps": {"wait": {"kind": "wait", "for": "2d", "next": "bought"}, "bought": {"kind": "branch", "event": "purchase", "then": "thank", "otherwise": "nudge"}, "thank": {"kind": "set_fact", "value": "customer", "next": "end"}, "nudge": {"kind": "add_to_list", "value": "nudge", "next": "end"}, "end": {"kind": "exit"}}}
        out = journeys.run_journeys(events.select(F.col("user_id").alias("passport_id"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("type")), plan)
    elif what == "sessions":
        out = stateful.campaign_sessions(events.select(F.col("user_id").alias("passport_id"), "ts", F.col("event_id").alias("id"), F.lit(None).cast("string").alias("campaign")), 360)
    else:
        out = stateful.windowed(events.withColumn("channel", F.col("event_type")), "1 day")
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# ---- further predicates, scopes, lists and writes -----------------------------------------------------

_cohort("fact_gt", {"fact": {"acctbal": {"gt": 5000}}}, _CUSTOMER + "c_acctbal > 5000", ORDER_NOW)
_cohort("fact_lte", {"fact": {"acctbal": {"lte": 0}}}, _CUSTOMER + "c_acctbal <= 0", ORDER_NOW)
_cohort("fact_next", {"fact": {"first_purchase_at": {"next": "2w"}}}, f"WITH {EV}, {ANCH} SELECT passport_id, strftime(a, '{DAY}') AS matched_at FROM anch WHERE a BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22'", "2024-01-08")
_cohort("fact_before", {"fact": {"first_purchase_at": {"before": "3w"}}}, f"WITH {EV}, {ANCH} SELECT passport_id, strftime(a, '{DAY}') AS matched_at FROM anch WHERE a < TIMESTAMP '2024-01-10'")
_cohort("fact_held_window", {"fact": {"order_priority": {"held": {"last": "1y"}}}}, f"WITH {ORD} SELECT passport_id, strftime(max(obs), '{DAY}') AS matched_at FROM ord WHERE obs BETWEEN TIMESTAMP '2000-08-02' AND TIMESTAMP '2001-08-02' GROUP BY 1", ORDER_NOW)
_cohort("fact_distinct_most", {"fact": {"order_priority": {"distinct": {"lte": 2}}}}, f"WITH {ORD} SELECT passport_id, strftime(max(obs), '{DAY}') AS matched_at FROM ord GROUP BY 1 HAVING count(DISTINCT pri) <= 2", ORDER_NOW)
_cohort("filter_tree", {"any": [{"all": [TREE[0], {"not": TREE[2]}]}, TREE[1]]}, f"WITH {EV}, {_A}, {_B}, {_C} SELECT passport_id, strftime(min(t), '{DAY}') AS matched_at FROM (SELECT * FROM a WHERE passport_id NOT IN (SELECT passport_id FROM c) UNION ALL SELECT * FROM b) GROUP BY 1")


@query(f"WITH {EV}, {_A} SELECT passport_id, strftime(t, '{DAY}') AS matched_at FROM a WHERE passport_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_scope(spark, sf_dir):
    w = world(spark, sf_dir)
    return _stamped(cohort.people(w, {"filter": TREE[0]}, cohort.people(w, {"filter": {"fact": {"segment": "BUILDING"}}})))


@query(f"WITH {EV} SELECT passport_id, count(*) AS n, count(DISTINCT channel) AS channels FROM ev WHERE direction = 'exposure' GROUP BY 1")
def exposure_counts(spark, sf_dir):
    rows = model(spark, sf_dir).events.filter("direction = 'exposure'")
    return rows.groupBy("passport_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel").alias("channels"))


@query(f"WITH {EV} SELECT channel, count(*) AS n FROM ev WHERE passport_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def erase_people(spark, sf_dir):
    m = model(spark, sf_dir)
    gone = fact_ops.current(m.facts, "segment").filter("value = 'BUILDING'")
    return identity.erase(m.events, gone).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT DISTINCT 'list-' || (o_custkey % 5) AS list, o_custkey AS passport_id FROM orders UNION SELECT 'rich', c_custkey FROM customer WHERE c_acctbal > 5000) SELECT c_custkey AS passport_id, coalesce(g.n, 0) AS n, coalesce(g.lists, '') AS lists FROM customer LEFT JOIN (SELECT passport_id, count(*) AS n, string_agg(list, ',' ORDER BY list) AS lists FROM l GROUP BY 1) g ON passport_id = c_custkey")
def list_membership(spark, sf_dir):
    m = model(spark, sf_dir)
    bought = m.table("orders").select(F.concat(F.lit("list-"), (F.col("o_custkey") % 5).cast("string")).alias("list"), F.col("o_custkey").alias("passport_id"))
    rich = m.table("customer").filter("c_acctbal > 5000").select(F.lit("rich").alias("list"), F.col("c_custkey").alias("passport_id"))
    held = audience.membership(m.passports.select(F.col("id").alias("passport_id")), audience.add_to_list(bought, rich))
    return held.select("passport_id", F.size("lists").cast("long").alias("n"), F.array_join("lists", ",").alias("lists"))


@query("WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS contact FROM customer) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'suppressed' WHEN c_custkey % 5 = 0 THEN 'invalid' ELSE 'ok' END AS verdict FROM b) GROUP BY 1")
def batch_suppression(spark, sf_dir):
    names = model(spark, sf_dir).table("customer").select("c_custkey", F.col("c_name").alias("contact"))
    batch = names.withColumn("contact", F.when(F.col("c_custkey") % 2 == 0, F.upper("contact")).otherwise(F.col("contact")))
    return audience.sendable(batch, names.filter("c_custkey % 7 = 0"), names.filter("c_custkey % 5 = 0")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ORD}, b AS (SELECT passport_id, CASE passport_id % 3 WHEN 0 THEN 'X' ELSE st END AS value, CASE WHEN passport_id % 4 = 0 THEN obs - INTERVAL 1 DAY ELSE obs END AS seen, CASE WHEN passport_id % 5 = 0 THEN 'x' END AS external, st, obs FROM cur) SELECT passport_id, value FROM b WHERE NOT (value = st AND seen >= obs AND external IS NULL)")
def write_suppression(spark, sf_dir):
    held = fact_ops.current(model(spark, sf_dir).facts, "order_status").withColumn("key", F.lit("order_status"))
    p = F.col("passport_id")
    batch = held.select("passport_id", "key", F.when(p % 3 == 0, "X").otherwise(F.col("value")).alias("value"), F.when(p % 4 == 0, F.col("observed_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("observed_at")).alias("observed_at"), F.when(p % 5 == 0, "x").alias("external_id"))
    return fact_ops.news(batch, held).select("passport_id", "value")


@query(f"WITH {ORD}, a AS (SELECT passport_id, count(DISTINCT st) AS s, count(DISTINCT pri) AS p FROM ord GROUP BY 1) SELECT 'order_status' AS fact, 'ambiguous_anchor_fact' AS code, count(*) FILTER (s > 1) AS affected, round(count(*) FILTER (s > 1) * 100.0 / count(*), 1) AS percent, max(s) AS most_values, 'first' AS used FROM a UNION ALL SELECT 'order_priority', 'ambiguous_fact_value', count(*) FILTER (p > 1), round(count(*) FILTER (p > 1) * 100.0 / count(*), 1), max(p), 'last' FROM a")
def fact_notes(spark, sf_dir):
    log = model(spark, sf_dir).facts
    return fact_ops.notes(log, ["order_status", "order_priority", "order_total", "segment"], {"order_status": "max", "order_total": "min"}, anchors={"order_status": "first"})


@query(f"WITH {CH}, {CT}, p AS (SELECT DISTINCT doc_id, passport_id FROM ct WHERE passport_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), nr AS (SELECT doc_id, sim FROM ch WHERE sim >= 0.0 AND doc_id IN (SELECT doc_id FROM p) ORDER BY ch.sim DESC, doc_id LIMIT 50) SELECT doc_id, passport_id, round(sim, 4) AS sim FROM p JOIN nr USING (doc_id) ORDER BY nr.sim DESC, doc_id, passport_id LIMIT 30")
def knowledge_of_a_cohort(spark, sf_dir):
    m = model(spark, sf_dir)
    building = fact_ops.current(m.facts, "segment").filter("value = 'BUILDING'")
    return semantic.knowledge(m.chunks, _contacts(m), _query_vector(m), cohort=building, k=30, floor=0.0, candidates=50)


@query(f"WITH {CT} SELECT doc_id, CAST(NULL AS BIGINT) AS passport_id, CAST(NULL AS DOUBLE) AS sim FROM (SELECT doc_id, count(DISTINCT passport_id) AS people FROM ct GROUP BY 1 ORDER BY people DESC, doc_id LIMIT 20)")
def knowledge_sample(spark, sf_dir):
    m = model(spark, sf_dir)
    return semantic.knowledge(m.chunks, _contacts(m))


@query(f"WITH {CLASSED} SELECT type, count(*) AS n, count(DISTINCT passport_id) AS passports, strftime(max(ts), '{DAY}') AS last_at FROM cl WHERE type LIKE 'mail.%' GROUP BY 1")
def registry_activity(spark, sf_dir):
    return live.activity(live.registry(model(spark, sf_dir).events), "mail.").withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {EV} SELECT count(*) AS n, round(count(*) / 1440.0, 2) AS per_minute FROM ev WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20'")
def registry_rate(spark, sf_dir):
    return live.rate(live.registry(model(spark, sf_dir).events), F.lit("2024-01-20").cast("timestamp"), 1440)


@query("SELECT c_custkey AS passport_id, '+359' || CAST(880000000 + c_custkey AS VARCHAR) AS phone, '+359\u2022\u2022\u2022' || right(CAST(880000000 + c_custkey AS VARCHAR), 2) AS shown FROM customer")
def phones(spark, sf_dir):
    rows = model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("passport_id"), F.concat(F.lit("0"), (F.lit(880000000) + F.col("c_custkey")).cast("string")).alias("raw"))
    given = F.concat(F.substring("raw", 1, 4), F.lit(" ("), F.substring("raw", 5, 3), F.lit(") "), F.substring("raw", 8, 3))
    return rows.withColumn("phone", exprs.e164(given, "359")).select("passport_id", "phone", exprs.mask_phone(F.col("phone")).alias("shown"))


@query("SELECT c_custkey AS passport_id, left(c_name, 1) || '\u2022\u2022\u2022' AS shown, left(c_name, 1) || '\u2022\u2022\u2022@x.org' AS mail FROM customer")
def masks(spark, sf_dir):
    return model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("passport_id"), exprs.mask(F.col("c_name")).alias("shown"), exprs.mask_email(F.concat("c_name", F.lit("@x.org"))).alias("mail"))


# ---- descriptions, cross-tabs over facts, links ---------------------------------------------------------


@query(f"""WITH {FACT_ROWS.replace("CAST(min(ts) AS VARCHAR)", "strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f')")}
SELECT key, CASE WHEN key IN ('order_total', 'acctbal') THEN 'number' WHEN key = 'first_purchase_at' THEN 'date' ELSE 'string' END AS type,
  coalesce(CAST(min(num) AS VARCHAR), min(v)) AS low, coalesce(CAST(max(num) AS VARCHAR), max(v)) AS high,
  array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 8), '|') AS sample, CASE WHEN count(DISTINCT v) <= 25 THEN array_to_string(list_sort(list(DISTINCT v)), '|') END AS vals FROM f GROUP BY key""")
def fact_descriptions(spark, sf_dir):
    joined = [F.array_join(c, "|").alias(name) for c, name in (("sample", "sample"), ("values", "vals"))]
    return fact_ops.described(model(spark, sf_dir).facts).select("key", "type", "low", "high", *joined)


@query(f"WITH {EV}, k AS (SELECT source, channel, unnest(['value', 'k']) AS key, unnest([CAST(a_value AS VARCHAR), a_k]) AS v FROM ev) SELECT key, count(*) AS n_rows, count(DISTINCT v) AS n_values, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ',') AS sources, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM k WHERE v IS NOT NULL GROUP BY key")
def attribute_keys(spark, sf_dir):
    return ingest.attribute_keys(model(spark, sf_dir).events)


@query(f"WITH {EV}, j AS (SELECT DISTINCT channel, a_event, passport_id, c_acctbal FROM ev JOIN customer ON c_custkey = passport_id WHERE c_mktsegment = 'BUILDING'), s AS (SELECT a_event FROM (SELECT DISTINCT a_event, passport_id, c_acctbal FROM j) GROUP BY 1 ORDER BY round(avg(c_acctbal), 4) DESC NULLS LAST, 1 LIMIT 3) SELECT channel AS bucket, a_event AS series, round(avg(c_acctbal), 4) AS value FROM j WHERE a_event IN (SELECT a_event FROM s) GROUP BY 1, 2")
def crosstab_fact_avg(spark, sf_dir):
    m = model(spark, sf_dir)
    building = fact_ops.current(m.facts, "segment").filter("value = 'BUILDING'")
    return metrics.cross_tab(m.events, {"avg": {"fact": "acctbal"}}, ("channel", "attr:event"), EVENT_NOW, m.facts, series_limit=3, cohort=building)


@query(f"WITH {EV} SELECT CAST(least(count(DISTINCT a_event), 3) AS BIGINT) AS shown, count(DISTINCT a_event) AS series, count(DISTINCT a_event) > 3 AS truncated, count(DISTINCT passport_id) AS cohort_size FROM ev")
def crosstab_extent(spark, sf_dir):
    return metrics.cross_tab_extent(model(spark, sf_dir).events, {"count": {}}, ("channel", "attr:event"), EVENT_NOW, series_limit=3)


@query(f"WITH {EV}, {ANCH}, c AS (SELECT strftime(a, '%G-W%V') AS bucket, count(*) AS value FROM anch GROUP BY 1) SELECT bucket, value, (SELECT count(*) FROM c) AS total_buckets FROM c ORDER BY value DESC, bucket LIMIT 12")
def breakdown_weeks(spark, sf_dir):
    return composition.breakdown(model(spark, sf_dir).facts, "first_purchase_at", grain="week")


@query(f"WITH {CH}, {CT}, e AS (SELECT * FROM (SELECT *, CASE source WHEN 'text' THEN dwell_ms / 600.0::DOUBLE END AS engagement FROM ct) WHERE (engagement IS NULL OR engagement >= 0.5) AND passport_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), nr AS (SELECT doc_id, sim FROM ch WHERE sim >= 0.0 AND doc_id IN (SELECT doc_id FROM e) ORDER BY sim DESC, doc_id LIMIT 20) SELECT doc_id, count(DISTINCT passport_id) AS people, round(max(sim), 4) AS sim, strftime(max(ts), '{DAY}') AS latest FROM e JOIN nr USING (doc_id) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def population_scoped(spark, sf_dir):
    m = model(spark, sf_dir)
    building = fact_ops.current(m.facts, "segment").filter("value = 'BUILDING'")
    return semantic.population(m.chunks, _contacts(m), _query_vector(m), 20, floor=0.0, min_engagement=0.5, scope=building, since="2024-01-10")


SIGHTED = """s AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'fingerprint' WHEN 1 THEN 'phone' WHEN 2 THEN 'email' ELSE 'weak' END AS type,
    user_id * (event_id % 4 + 1) // 4 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS value, user_id AS passport_id, ts AS seen_at FROM events WHERE user_id IS NOT NULL),
  w AS (SELECT *, CASE type WHEN 'fingerprint' THEN 7 WHEN 'phone' THEN 30 WHEN 'email' THEN 365 ELSE -1 END AS days, lag(seen_at) OVER o AS before, first(passport_id) OVER o AS holder FROM s WINDOW o AS (PARTITION BY type, value ORDER BY seen_at, id)),
  p AS (SELECT passport_id AS a, holder AS b, min(row(seen_at, id)) AS f, min(seen_at) AS seen_at FROM w WHERE (floor(epoch(seen_at)) - floor(epoch(before))) // 86400 <= days AND passport_id <> holder GROUP BY 1, 2),
  e AS (SELECT row_number() OVER (ORDER BY f) AS k, a, b, seen_at FROM p),
  r AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list(i) FROM range((SELECT max(user_id) + 1 FROM events)) t(i)) AS tops, CAST(NULL AS BIGINT) AS absorbed, CAST(NULL AS BIGINT) AS survivor, CAST(NULL AS TIMESTAMP) AS seen_at
    UNION ALL SELECT e.k, list_transform(tops, lambda x: CASE WHEN x = tops[b + 1] THEN tops[a + 1] ELSE x END), tops[b + 1], tops[a + 1], e.seen_at FROM r JOIN e ON e.k = r.k + 1)"""


def _sighted(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "fingerprint").when(e % 4 == 1, "phone").when(e % 4 == 2, "email").otherwise("weak")
    value = F.floor(F.col("user_id") * (e % 4 + 1) / 4) + F.when(e % 97 == 0, 1).otherwise(0)
    return model(spark, sf_dir).table("events").select(e.alias("id"), kind.alias("type"), value.alias("value"), F.col("user_id").alias("passport_id"), F.col("ts").cast("timestamp").alias("seen_at"))


@query(f"WITH RECURSIVE {SIGHTED} SELECT absorbed, survivor, strftime(seen_at, '{DAY}') AS merged_at FROM r WHERE absorbed <> survivor")
def identity_links(spark, sf_dir):
    return identity.linked(_sighted(spark, sf_dir)).withColumn("merged_at", F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH RECURSIVE {SIGHTED}, z AS (SELECT tops FROM r ORDER BY k DESC LIMIT 1), u AS (SELECT unnest(range(len(tops))) AS absorbed, unnest(tops) AS survivor FROM z) SELECT absorbed, survivor FROM u WHERE absorbed <> survivor")
def identity_survivors(spark, sf_dir):
    return identity.survivors(identity.linked(_sighted(spark, sf_dir)))


@query(f"WITH RECURSIVE {SIGHTED}, z AS (SELECT tops FROM r ORDER BY k DESC LIMIT 1), u AS (SELECT unnest(range(len(tops))) AS id, unnest(tops) AS top FROM z) SELECT top AS passport_id, count(*) AS n, count(DISTINCT user_id) AS sides FROM events JOIN u ON u.id = user_id GROUP BY 1")
def events_of_linked_people(spark, sf_dir):
    m = model(spark, sf_dir)
    rows = m.events.withColumn("side", F.col("passport_id"))
    known = identity.resolve(rows, identity.survivors(identity.linked(_sighted(spark, sf_dir))))
    return known.groupBy("passport_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides"))


_PEOPLE = """pp AS (SELECT c_custkey AS id, max(ts) AS seen FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1),
  vv AS (SELECT c_custkey AS pid, c_name AS v FROM customer UNION ALL SELECT pid, v FROM f)"""


def _searched(text: str, **options):
    def run(spark, sf_dir):
        m = model(spark, sf_dir)
        seen = m.events.groupBy(F.col("passport_id").alias("id")).agg(F.max("ts").alias("last_seen_at"))
        names = m.table("customer").select(F.col("c_custkey").alias("passport_id"), F.col("c_name").alias("value"))
        gone = m.passports.filter("id % 7 = 3").select(F.col("id").alias("absorbed"), (F.col("id") - 3).alias("survivor"))
        made = {k: people.grams_of(m.facts.select("value").union(names.select("value"))) if v is True else v for k, v in options.items()}
        found = people.search(m.passports.join(seen, "id", "left"), m.facts, names, text, merges=gone, **made)
        return found.select("id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"))

    return run


_FOUND = f"WITH {FACT_ROWS}, {_PEOPLE} SELECT id, strftime(seen, '{DAY}') AS last_seen_at FROM pp WHERE id % 7 <> 3 AND "
for name, text, options, where in (
    ("people_search", "91", {}, "(CAST(id AS VARCHAR) LIKE '91%' OR id IN (SELECT pid FROM vv WHERE contains(v, '91')))"),
    ("people_search_grams", "rniTUre", {"grams": True}, "id IN (SELECT pid FROM vv WHERE contains(lower(v), 'rniture'))"),
    ("people_search_ids", "1", {"fields": "id,nothing"}, "CAST(id AS VARCHAR) LIKE '1%'"),
):
    run = _searched(text, **options)
    run.__name__ = name
    query(_FOUND + where)(run)


@query("SELECT sha256(text) AS content_hash FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL GROUP BY 1 HAVING bool_and(doc_id % 3 <> 0)")
def embed_once(spark, sf_dir):
    chunks = model(spark, sf_dir).chunks
    return ingest.to_embed(chunks, chunks.filter("doc_id % 3 = 0")).select("content_hash")


def _tried(chunks):
    """Earlier calls of some contents: from none to six, the last of them at a time of its own."""
    of = chunks.groupBy("content_hash").agg(F.min("doc_id").alias("d")).filter("d % 5 <> 4")
    return of.select("content_hash", (F.col("d") % 7).cast("int").alias("attempts"), F.timestamp_seconds(F.lit(1706659200) + (F.col("d") % 11 - 5) * 60).alias("next_at"), F.lit("busy").alias("failed"))


TRIED = """c AS (SELECT sha256(text) AS content_hash, min(doc_id) AS d, bool_or(doc_id % 3 = 0) AS done, any_value(text) AS text FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL GROUP BY 1),
  t AS (SELECT content_hash, CASE WHEN d % 5 <> 4 THEN d % 7 END AS a, CASE WHEN d % 5 <> 4 THEN TIMESTAMP '2024-01-31' + to_minutes(d % 11 - 5) END AS nx, done, regexp_matches(text, '[^ \\t-\\r]') AS worded, length(text) % 2 = 1 AS bad FROM c),
  r AS (SELECT *, worded AND NOT done AND (a IS NULL OR (a < 5 AND nx <= TIMESTAMP '2024-01-31')) AS due FROM t)"""


@query(f"WITH {TRIED} SELECT content_hash FROM r WHERE due")
def embed_due(spark, sf_dir):
    chunks = model(spark, sf_dir).chunks.filter("content_hash IS NOT NULL")
    return ingest.to_embed(chunks, chunks.filter("doc_id % 3 = 0"), _tried(chunks), F.lit("2024-01-31").cast("timestamp")).select("content_hash")


@query(f"""WITH {TRIED}, n AS (SELECT *, coalesce(a, 0) + CASE WHEN due THEN 1 ELSE 0 END AS n FROM r WHERE (due AND bad) OR (NOT due AND a IS NOT NULL))
  SELECT content_hash, n::INT AS attempts, CASE WHEN NOT due THEN strftime(nx, '{DAY}') WHEN n < 5 THEN strftime(TIMESTAMP '2024-01-31' + to_seconds(5 * (1 << (n - 1)::INT)), '{DAY}') END AS next_at, CASE WHEN due THEN 'ValueError: odd' ELSE 'busy' END AS failed FROM n""")
def embed_retries(spark, sf_dir):
    chunks = model(spark, sf_dir).chunks.filter("content_hash IS NOT NULL")
    now = F.lit("2024-01-31").cast("timestamp")

    def lengths(texts):
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd")
        return [[float(len(t))] for t in texts]

    tries = _tried(chunks)
    results = ingest.embed(ingest.to_embed(chunks, chunks.filter("doc_id % 3 = 0"), tries, now), lengths)
    return ingest.tries_after(tries, results, now).withColumn("next_at", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY passport_id ORDER BY ts, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM ev),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY passport_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS burst FROM b)
  SELECT passport_id, strftime(max(ts) + INTERVAL 6 HOUR, '{DAY}') AS recheck_at, count(*) AS n FROM g GROUP BY passport_id, burst""")
def debounced_rechecks(spark, sf_dir):
    return ingest.rechecks(model(spark, sf_dir).events, "6 hours").withColumn("recheck_at", F.date_format("recheck_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {EV}, r AS (SELECT *, CASE WHEN passport_id BETWEEN 1 AND 9 THEN 0 WHEN passport_id BETWEEN 10 AND 999 THEN 0 ELSE passport_id END AS who FROM ev),
  e AS (SELECT DISTINCT passport_id, min(ts) OVER (PARTITION BY passport_id) AS enrolled_at FROM ev WHERE a_event = 'signup')
  SELECT e.passport_id, strftime(e.enrolled_at, '{DAY}') AS enrolled_at FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.who = e.passport_id AND a_event = 'purchase' AND r.ts BETWEEN e.enrolled_at AND e.enrolled_at + INTERVAL 14 DAY)""")
def goals_of_merged(spark, sf_dir):
    m = model(spark, sf_dir)
    started = m.events.filter("attr_event = 'signup'").groupBy("passport_id").agg(F.min("ts").alias("enrolled_at"))
    bought = m.events.filter("attr_event = 'purchase'").select("passport_id", F.col("ts").alias("occurred_at"))
    met = audience.converted_within(started, bought, 14, identity.survivors(m.merges))
    return met.select("passport_id", F.date_format("enrolled_at", "yyyy-MM-dd HH:mm:ss").alias("enrolled_at"))


# ---- audiences kept warm, what other systems send, pages, further steps and scopes ----------------------

BETWEEN = {"metric": {**PURCHASES, "count": {"gte": 3, "lte": 9}}}
_SPLIT = "2024-01-15"


@query(f"""WITH {EV}, a AS (SELECT passport_id FROM ev WHERE {BOUGHT} AND ts < TIMESTAMP '{_SPLIT}' GROUP BY 1 HAVING count(*) BETWEEN 3 AND 9), b AS (SELECT passport_id FROM ev WHERE {BOUGHT} GROUP BY 1 HAVING count(*) BETWEEN 3 AND 9)
  SELECT passport_id, 'entered' AS change, '{_SPLIT}' AS at FROM a UNION ALL SELECT passport_id, 'entered', '{EVENT_NOW}' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT passport_id, 'left', '{EVENT_NOW}' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def warm_audience(spark, sf_dir):
    """Everybody at first, then only those with events since."""
    store = FactStore(spark, f"{shared_folder(spark)}/warm-{uuid.uuid4().hex}")
    now = world(spark, sf_dir)
    early, late = now.events.filter(F.col("ts") < _SPLIT), now.events.filter(F.col("ts") >= _SPLIT)
    warm.sweep(store, "regulars", replace(now, events=early, now=_SPLIT), BETWEEN, batch=0)
    for _ in range(2):  # the second time changes nothing
        warm.refresh(store, "regulars", now, BETWEEN, late.select("passport_id"), batch=1)
    return warm.changes(store, "regulars").withColumn("at", F.date_format("at", "yyyy-MM-dd"))


@query(f"WITH {EV}, {_A}, {_C} SELECT passport_id FROM a WHERE passport_id IN (SELECT passport_id FROM c)")
def trigger_audiences(spark, sf_dir):
    store = FactStore(spark, f"{shared_folder(spark)}/triggers-{uuid.uuid4().hex}")
    w = world(spark, sf_dir)
    for name, node in (("buyers", TREE[0]), ("builders", TREE[2])):
        warm.sweep(store, name, w, node)
    return warm.entered_at(store, ["buyers", "builders"], "all").select("passport_id")


@query(f"WITH {EV}, {_A}, {_B}, {_C}, p AS (SELECT passport_id FROM a UNION SELECT passport_id FROM c EXCEPT SELECT passport_id FROM b), k AS (SELECT passport_id, lower(c_mktsegment) || '-' || passport_id // 2 AS contact FROM p JOIN customer ON c_custkey = passport_id) SELECT min(passport_id) AS passport_id, contact FROM k WHERE contact NOT IN (SELECT lower(c_mktsegment) || '-' || c_custkey // 2 FROM customer WHERE c_custkey % 7 = 0) GROUP BY 2")
def campaign_recipients(spark, sf_dir):
    w = world(spark, sf_dir)
    a, b, c = (cohort.evaluate(w, n) for n in TREE)
    contacts = model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("passport_id"), F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("contact"))
    return audience.recipients([a, c], [b], contacts, contacts.filter("passport_id % 7 = 0"), contacts.limit(0))


@query("WITH h AS (SELECT o_custkey AS p, 'shop:order:' || o_orderkey AS c, 'old' AS t FROM orders UNION ALL SELECT o_custkey, 'shop:stay:' || o_orderkey, 'old' FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT p, c, t FROM h WHERE NOT (starts_with(c, 'shop:order:') AND p IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0)) UNION ALL SELECT o_custkey, 'shop:order:' || o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0) SELECT p AS passport_id, count(*) AS n, count(*) FILTER (t = 'old') AS held, max(c) AS last FROM k GROUP BY 1")
def crm_replace(spark, sf_dir):
    orders = model(spark, sf_dir).table("orders")
    given = {"passport_id": F.col("o_custkey"), "ts": F.col("o_orderdate").cast("timestamp"), "channel": F.lit("crm"), "direction": F.lit("expression"), "source": F.lit("shop"), "text": F.lit("old"), "meta": F.lit("{}"), "plugin": F.lit("crm")}
    row = lambda df, kind: df.withColumns({**given, "content_id": F.concat(F.lit(f"shop:{kind}:"), F.col("o_orderkey").cast("string"))}).select(*crm.EXPOSURE)
    held = row(orders, "order").unionByName(row(orders.filter("o_orderstatus = 'P'"), "stay"))
    sent = orders.filter("o_orderstatus = 'F' AND o_custkey % 3 = 0").select(F.col("o_custkey").alias("passport_id"), F.lit("shop").alias("source"), F.lit("ordered").alias("event"), F.concat(F.lit("shop:order:"), F.col("o_orderkey").cast("string")).alias("external_id"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("direction"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit("shop:order:").alias("replace"))
    once = crm.ingest_events(held, sent)
    return crm.ingest_events(once, sent).groupBy("passport_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "old").alias("held"), F.max("content_id").alias("last"))


@query("SELECT 'deal:' || o_orderkey AS entity, 'shop:fact:' || o_orderpriority || ':' || o_orderkey AS content_id, sha256(o_orderpriority) AS h FROM orders WHERE o_orderstatus <> 'P'")
def crm_notes(spark, sf_dir):
    orders = model(spark, sf_dir).table("orders")
    rows = orders.select(F.col("o_custkey").alias("passport_id"), F.lit("shop").alias("source"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("body"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("deal").alias("ref_kind"), F.col("o_orderkey").alias("ref_id"))
    return crm.notes(rows).select(F.get_json_object("meta", "$.ref.entity").alias("entity"), "content_id", F.sha2("text", 256).alias("h"))


@query("""WITH e AS (SELECT event_id AS i, event_id % 4 AS k FROM events) SELECT CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'text' WHEN 2 THEN 'link' END AS kind,
  CASE WHEN k = 3 THEN 'kind' WHEN k = 0 AND i % 5 = 0 THEN 'src' WHEN k = 1 AND i % 700 < 5 THEN 'length_chars' END AS reject, count(*) AS n, CAST(sum(CASE WHEN k = 1 THEN i % 700 - 5 END) AS BIGINT) AS chars FROM e GROUP BY 1, 2""")
def engagement_parsed(spark, sf_dir):
    i = F.col("id")
    text = F.to_json(F.struct(F.lit("engagement.text").alias("type"), F.lit("Read this").alias("text"), (i % 700 - 5).alias("length_chars")))
    video = F.to_json(F.struct(F.lit("video").alias("kind"), F.struct(F.when(i % 5 != 0, "https://x.org/v").alias("src"), F.lit(1.5).alias("total_watched_s")).alias("data")))
    link, other = F.lit('{"type":"engagement.link","text":"Go"}'), F.lit('{"type":"engagement.smell"}')
    one = F.when(i % 4 == 0, video).when(i % 4 == 1, text).when(i % 4 == 2, link).otherwise(other)
    rows = model(spark, sf_dir).events.select("id", F.concat(F.lit('{"events":['), one, F.lit("]}")).alias("payload"))
    return crm.parsed(rows.withColumnRenamed("id", "row")).groupBy("kind", "reject").agg(F.count(F.lit(1)).alias("n"), F.sum("length_chars").alias("chars"))


@query(f"WITH {EV}, p AS (SELECT * FROM ev WHERE channel IN ('web', 'crm') ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100) SELECT id, channel, strftime(ts, '{DAY}') AS ts, (SELECT count(*) > 150 FROM ev WHERE channel IN ('web', 'crm')) AS more FROM p")
def timeline_seek(spark, sf_dir):
    rows = metrics.apply_filters(model(spark, sf_dir).events, {"channel": ["web", "crm"]}, EVENT_NOW)
    page = ranks.page(rows, ["ts", "id"], 50, ranks.page_begins(rows, ["ts", "id"], 50, 2))
    return page.select("id", "channel", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "more")


@query(f"WITH {VIS.replace('user_id AS passport_id', 'CASE WHEN user_id BETWEEN 1 AND 999 THEN 0 ELSE user_id END AS passport_id')} SELECT passport_id, max(seq) + 1 AS sessions, strftime(min(ts), '{DAY}') AS first_session FROM vis GROUP BY 1")
def sessions_of_merged(spark, sf_dir):
    m = model(spark, sf_dir)
    theirs = sessions.sessionize(identity.resolve(m.events, identity.survivors(m.merges)), "24 hours")
    return theirs.groupBy("passport_id").agg((F.max("session_seq") + 1).alias("sessions"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_session"))


@query(f"WITH {EV} SELECT source AS kind, count(*) AS n FROM ev WHERE source IN ('video', 'text') GROUP BY 1")
def content_kinds(spark, sf_dir):
    return live.content_kinds(model(spark, sf_dir).events)


@query(f"WITH {EV} SELECT (SELECT count(*) FROM customer) AS people, count(DISTINCT passport_id) AS active, count(*) AS events FROM ev")
def base_totals(spark, sf_dir):
    m = model(spark, sf_dir)
    return live.totals(m.events, m.passports)


@query(f"WITH {CLASSED} SELECT id, type, strftime(ts, '{DAY}') AS occurred_at FROM cl WHERE type LIKE 'mail.%' AND passport_id = 7 ORDER BY cl.ts DESC, id DESC LIMIT 20")
def registry_recent(spark, sf_dir):
    rows = live.recent(live.registry(model(spark, sf_dir).events), 20, prefix="mail.", passport_id=7)
    return rows.select("id", "type", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


EXC = EX.replace("p.url, split_part", "p.url, 'page:' || p.page_id AS cid, sha256(p.url) AS chash, split_part")
_IDS = "'page:1', 'page:22', 'page:7'"
_grouped("filter_content_id", {"content": {"id": {"in": ["page:1", "page:22", "page:7"]}}, "count": {}}, "channel", "channel", "count(*)", rows="exposures", source=EXC, table="ex", where=f"cid IN ({_IDS})")
_grouped("filter_content_text", {"content": "GE:1", "count": {}}, "content", "cid", "count(*)", rows="exposures", source=EXC, table="ex", where="contains(cid, 'ge:1')")
_grouped("filter_content_present", {"content": {"url": {"present": True}}, "distinct_passports": {}}, "content_hash", "chash", "count(DISTINCT passport_id)", rows="exposures", source=EXC, table="ex", where="url IS NOT NULL")
_grouped("median_by_attr", {"median": {"field": "value"}}, "attr:event", "a_event", "round(quantile_cont(a_value, 0.5), 4)")
_grouped("attr_eq_number", {"attrs": {"k": {"eq": 1}}, "count": {}}, "channel", "channel", "count(*)", where="a_k = '1'")


@query(f"WITH {FUNNEL}, g AS (SELECT DISTINCT passport_id FROM ev JOIN f2 USING (passport_id) WHERE a_event = 'purchase' AND ts > a) SELECT count(*) AS n FROM g")
def funnel_named(spark, sf_dir):
    steps = [*STEPS[:2], {"name": "bought", "use": "buyers"}]
    parts = cohort.funnel(world(spark, sf_dir), steps, named={"buyers": STEPS[2]["filter"]})
    return parts[-1].agg(F.count_distinct("passport_id").alias("n"))


@query(f"WITH {FUNNEL}, g AS (SELECT DISTINCT passport_id FROM ev JOIN f2 USING (passport_id) WHERE a_event = 'purchase' AND ts > a) SELECT passport_id FROM g WHERE passport_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def funnel_tree_step(spark, sf_dir):
    steps = [*STEPS[:2], {"name": "bought", "filter": {"all": [STEPS[2]["filter"], {"not": TREE[2]}]}}]
    return cohort.funnel(world(spark, sf_dir), steps)[-1].select("passport_id")


@query(f"WITH {EV} SELECT channel AS bucket, count(*) AS value, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev), 0) AS percent FROM ev GROUP BY 1")
def channel_shares(spark, sf_dir):
    return composition.shares(metrics.group(model(spark, sf_dir).events, {"count": {}}, "channel", EVENT_NOW))


@query(f"WITH {EV}, {_A}, s AS (SELECT passport_id FROM a ORDER BY 1 LIMIT 20), d AS (SELECT count(*) AS m FROM customer WHERE c_custkey IN (SELECT passport_id FROM s) AND length(c_mktsegment) >= 9 AND c_acctbal > 0) SELECT least((SELECT count(*) FROM a), 20) AS sampled, m AS matches, round(m / least((SELECT count(*) FROM a), 20), 4) AS rate, CAST(round(m / least((SELECT count(*) FROM a), 20) * (SELECT count(*) FROM a), 0) AS BIGINT) AS projected, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT passport_id FROM s) AND c_acctbal <= 0) AS failed FROM d")
def judge_projected(spark, sf_dir):
    evidence = model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("passport_id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("?").alias("evidence"))
    survivors = cohort.evaluate(world(spark, sf_dir), TREE[0])
    return semantic.projected(survivors, evidence, lambda text: len(text) / 10 if text != "?" else 1 / 0, threshold=0.9)


@query(f"WITH {VIS}, z AS (SELECT session_id, arg_min_null(utm_source, row(ts, id)) AS utm_source FROM vis GROUP BY 1) SELECT id, vis.channel, vis.session_id, z.utm_source FROM vis JOIN z USING (session_id) WHERE passport_id = 7 AND channel IN ('web', 'mail') AND ts >= TIMESTAMP '2024-01-05'")
def timeline_sessions(spark, sf_dir):
    visits = model(spark, sf_dir).visits()
    rows = sessions.timeline(visits, sessions.session_rows(visits), 7, since="2024-01-05", channels=["web", "mail"])
    return rows.select("id", "channel", "session_id", "utm_source")


@query(f"WITH {VIS} SELECT session_id, passport_id, strftime(min(ts), '{DAY}') AS started_at, strftime(max(ts), '{DAY}') AS last_activity_at, count(*) AS events, arg_min_null(utm_source, row(ts, id)) AS utm_source FROM vis GROUP BY 1, 2")
def session_table(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions.session_rows(model(spark, sf_dir).visits()).select("session_id", "passport_id", stamp("started_at"), stamp("last_activity_at"), "events", "utm_source")


@query(f"WITH {CLASSED} SELECT type, CASE WHEN type LIKE 'mail.%' THEN direction END AS recorded_direction, CASE WHEN type = 'mail.clicked' THEN channel END AS recorded_channel, count(*) AS n FROM cl WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def registry_recorded(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    said = F.struct(F.when(F.startswith("type", F.lit("mail.")), F.col("direction")).alias("direction"), F.when(F.col("type") == "mail.clicked", F.col("channel")).alias("channel"))
    return live.counts_by_type(rows.withColumn("meta", F.to_json(F.struct(said.alias("data")))), since="2024-01-10")


@query(f"WITH {EV} SELECT c_mktsegment AS name, strftime(ts, '%G-W%V') AS bucket, round(quantile_cont(a_value, 0.5), 4) AS value FROM ev JOIN customer ON c_custkey = passport_id WHERE {BOUGHT} AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2")
def compare_split_median(spark, sf_dir):
    m = model(spark, sf_dir)
    return composition.split_series(m.events, {**PURCHASES, "median": {"field": "value"}}, m.facts, "segment", ["BUILDING", "MACHINERY"], "week", EVENT_NOW)


@query(f"WITH {CH}, {VIS}, ne AS (SELECT count(*) AS n FROM embeddings), o AS (SELECT id % n AS doc_id, arg_max_null(CASE source WHEN 'text' THEN dwell_ms / 600.0::DOUBLE END, row(ts, id)) AS d, arg_max(session_id, row(ts, id)) AS session_id FROM vis CROSS JOIN ne WHERE passport_id = 7 GROUP BY 1), z AS (SELECT session_id, arg_min_null(utm_source, row(ts, id)) AS utm_source FROM vis GROUP BY 1) SELECT doc_id, round(sim, 4) AS sim, round(sim * (0.4 + 0.6 * coalesce(d, 1)), 4) AS rank_score, z.utm_source FROM ch JOIN o USING (doc_id) LEFT JOIN z USING (session_id) ORDER BY sim * (0.4 + 0.6 * coalesce(d, 1)) DESC, doc_id LIMIT 10")
def recall_sessions(spark, sf_dir):
    m = model(spark, sf_dir)
    visits = m.visits()
    n = m.table("embeddings").count()
    contacts = visits.withColumns({"doc_id": F.col("id") % n, "engagement": F.when(F.col("source") == "text", F.col("dwell_ms") / 600.0)})
    return semantic.recall(m.chunks, contacts, 7, _query_vector(m), 10, sessions=sessions.session_rows(visits))


_cohort("fact_date_gte", {"fact": {"first_purchase_at": {"gte": "2024-01-03", "lt": "2024-01-05T12:00:00"}}}, f"WITH {EV}, {ANCH} SELECT passport_id, strftime(a, '{DAY}') AS matched_at FROM anch WHERE a >= TIMESTAMP '2024-01-03' AND a < TIMESTAMP '2024-01-05 12:00:00'")
_cohort("fact_text_gt", {"fact": {"order_priority": {"gt": "3-MEDIUM"}}}, _CURRENT + "pri > '3-MEDIUM'", ORDER_NOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
