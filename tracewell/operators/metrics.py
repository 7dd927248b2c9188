"""Event metrics: filters, per-person gates with crossing times, grouped series and cross-tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import durations, exprs
from ..functions.durations import SpecError
from . import facts as fact_ops
from . import ranks

FILTERS = ("channel", "direction", "source", "content", "last", "since", "until", "asOf", "session", "attrs", "window")
GATES = ("count", "distinct_sessions", "sum_dwell_ms", "sum", "recency_days")
GROUPED = ("count", "distinct_sessions", "distinct_passports", "sum_dwell_ms", "sum", "avg", "min", "max", "median", "percentile", "earliest", "latest", "first_seen", "last_seen")
SESSION_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "referrer")
ATTR_OPS = ("eq", "ne", "in", "gt", "gte", "lt", "lte", "contains", "startsWith", "endsWith", "present")
GRAINS = ("hour", "day", "week", "month")
MISSING = ("exclude", "include", "only", "bucket")
NO_ANCHOR = "__no_anchor__"


def split(spec: dict, aggregates: tuple[str, ...]) -> tuple[dict, str, object]:
    """Filters, the one aggregate, and what it is given; anything else is an error."""
    filters, found = {}, []
    for k, v in spec.items():
        if k in FILTERS:
            filters[k] = v
        elif k in aggregates:
            found.append((k, v))
        else:
            raise SpecError(f'metric: unknown key "{k}"')
    if len(found) != 1:
        raise SpecError(f"metric: needs one aggregate of {'/'.join(aggregates)}")
    return filters, *found[0]


def needs_session(spec: dict, by: object = None) -> bool:
    names = by if isinstance(by, (list, tuple)) else [by]
    return bool(spec.get("session")) or "distinct_sessions" in spec or any(isinstance(b, str) and b.startswith("session:") for b in names)


def _label(col: Column, want, name: str) -> Column:
    if isinstance(want, (list, tuple)):
        return col.isin(list(want))
    if isinstance(want, dict):
        if "in" in want:
            return col.isin(list(want["in"]))
        if "present" in want:
            return col.isNotNull() if want["present"] else col.isNull()
        raise SpecError(f"metric: {name} needs a value, a list, {{in}} or {{present}}")
    return col == want


def _content(want) -> Column:
    if isinstance(want, str):
        return F.lit(True) if want == "*" else F.col("content_id").ilike(f"%{want}%")
    url = exprs.canonical_url(F.col("content_url"))
    out = F.lit(True)
    for k, v in want.items():
        if k == "prefix":
            out = out & F.startswith(url, F.lit(exprs.canonical(v)))
        elif k == "url" and isinstance(v, dict) and "prefix" in v:
            out = out & F.startswith(url, F.lit(exprs.canonical(v["prefix"])))
        elif k == "url" and isinstance(v, dict) and "present" in v:
            out = out & _label(F.col("content_url"), v, "content.url")
        elif k == "url":
            values = v["in"] if isinstance(v, dict) else v
            out = out & url.isin([exprs.canonical(x) for x in ([values] if isinstance(values, str) else values)])
        elif k in ("id", "hash"):
            out = out & _label(F.col(f"content_{k}"), v, f"content.{k}")
        else:
            raise SpecError(f'metric: content has no "{k}" (use url/id/hash/prefix)')
    return out


def _attr(columns: list[str], key: str, ops) -> Column:
    """Attribute tests: absent values meet none but present: false.

    eq, ne and in compare texts; the others numbers if the bound is one, else texts with their case.  A value alone is eq, a list is in.
    """
    value = exprs.attribute(columns, key)
    text = exprs.plain_text(value)
    numeric = value.try_cast("double") if f"attr_{key}" in columns else exprs.number(value)
    if ops is None or ops == {}:
        raise SpecError(f"metric: attrs.{key} has no condition (use a value, a list or {'/'.join(ATTR_OPS)})")
    out = F.lit(True)
    for op, b in (ops if isinstance(ops, dict) else {"in" if isinstance(ops, (list, tuple)) else "eq": ops}).items():
        if op not in ATTR_OPS:
            raise SpecError(f'metric: attrs.{key} has no operator "{op}" (use {"/".join(ATTR_OPS)})')
        if op == "present":
            out = out & (F.coalesce(F.array_contains(F.json_object_keys("meta"), key), F.lit(False)) == F.lit(b is not False))
            continue
        if op == "in":
            if not isinstance(b, (list, tuple)):
                raise SpecError(f"metric: attrs.{key}: in takes a list")
            out = out & text.isin([exprs.text_of(x) for x in b])
            continue
        number = isinstance(b, (int, float)) and not isinstance(b, bool)
        left, bound = (numeric, F.lit(float(b))) if number and op in ("gt", "gte", "lt", "lte") else (text, F.lit(exprs.text_of(b)))
        tests = {
            "eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y,
            "lte": lambda x, y: x <= y, "contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith,
        }
        out = out & tests[op](left, bound)
    return F.coalesce(out, F.lit(False))


def anchors(facts: DataFrame, spec: dict, name: str = "anchor", as_of: str | None = None) -> DataFrame:
    """(passport_id, anchor): the instant that a fact's value names for each passport."""
    extra = set(spec) - {"fact", "use"}
    if extra or "fact" not in spec:
        raise SpecError(f"metric: a window's anchor is {{fact, use}}, not {sorted(spec)}; for plain dates use last, since or until")
    rows = fact_ops.current(facts, spec["fact"], spec.get("use", "last"), as_of)
    return rows.select("passport_id", F.coalesce("at", F.try_to_timestamp(F.nullif("value", F.lit("")))).alias(name))


def apply_window(events: DataFrame, facts: DataFrame, spec: dict, as_of: str | None = None) -> DataFrame:
    """Rows on one side of each person's own instant: before is strict, after inclusive, so the two make the whole.

    `offset` moves the boundary, `within` bounds the far side.  missingAnchor says what becomes of people without an
    anchor; the column anchored tells them apart.
    """
    unknown = set(spec) - {"before", "after", "between", "offset", "within", "missingAnchor"}
    if unknown or sum(k in spec for k in ("before", "after", "between")) != 1:
        raise SpecError("metric: window takes one of before/after/between, and offset, within, missingAnchor")
    missing = spec.get("missingAnchor", "exclude")
    if missing not in MISSING:
        raise SpecError(f"metric: missingAnchor must be one of {'/'.join(MISSING)}")
    move = lambda c, s: c + F.make_dt_interval(secs=F.lit(s))
    offset = durations.seconds(spec["offset"], "offset") if "offset" in spec else 0
    ts = F.col("ts")
    if "between" in spec:
        first, second = spec["between"]
        out = events.join(anchors(facts, first, "_a", as_of), "passport_id", "left").join(anchors(facts, second, "_b", as_of), "passport_id", "left")
        anchored = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        inside = (ts >= move(F.col("_a"), offset)) & (ts < move(F.col("_b"), offset))
    else:
        side = "before" if "before" in spec else "after"
        out = events.join(anchors(facts, spec[side], "_a", as_of), "passport_id", "left").withColumn("_b", F.lit(None))
        anchored = F.col("_a").isNotNull()
        span = durations.seconds(spec["within"], "within") if "within" in spec else None
        inside = ts < move(F.col("_a"), offset) if side == "before" else ts >= move(F.col("_a"), offset)
        if span is not None:
            inside = inside & (ts >= move(F.col("_a"), offset - span) if side == "before" else ts < move(F.col("_a"), offset + span))
    keep = {"only": ~anchored, "exclude": anchored & inside}.get(missing, ~anchored | inside)
    return out.withColumn("anchored", anchored).filter(keep).drop("_a", "_b")


def apply_filters(events: DataFrame, filters: dict, now: str, facts: DataFrame | None = None) -> DataFrame:
    """All of an event metric's filters; row tests come first, so that they reach the scan."""
    clock = durations.instant(filters.get("asOf", now), "asOf")
    test = F.lit(True)
    if "asOf" in filters:
        test = test & (F.col("ts") <= clock)
    for k in ("channel", "direction", "source"):
        if filters.get(k) is not None:
            test = test & _label(F.col(k), filters[k], k)
    if "last" in filters:
        test = test & (F.col("ts") >= durations.shift(clock, filters["last"], -1, "last"))
    if "since" in filters:
        test = test & (F.col("ts") >= durations.instant(filters["since"], "since"))
    if "until" in filters:
        test = test & (F.col("ts") <= durations.instant(filters["until"], "until"))
    if filters.get("content") is not None:
        test = test & _content(filters["content"])
    for k, want in (filters.get("session") or {}).items():
        if k not in SESSION_KEYS:
            raise SpecError(f'metric: session has no "{k}" (use {"/".join(SESSION_KEYS)})')
        test = test & _label(F.col(k), want, f"session.{k}")
    for k, ops in (filters.get("attrs") or {}).items():
        test = test & _attr(events.columns, k, ops)
    out = events.filter(test)
    return apply_window(out, facts, filters["window"], filters.get("asOf")) if "window" in filters else out


# ---- gates -------------------------------------------------------------------


def gate(events: DataFrame, spec: dict, now: str, facts: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """(passport_id, matched_at) of those whose events meet the gate; only people with a matching event can.

    With gte, matched_at is the first event at which the running total reaches it.  Both bounds are honoured, values that
    are not numbers count as nothing, and events without a session are no session.  `after` (passport_id, anchor) counts
    only what came later than each person's anchor, and only these people.
    """
    filters, agg, bounds = split(spec, GATES)
    rows = apply_filters(events, filters, now, facts)
    if after is not None:
        rows = rows.join(after, "passport_id").filter(F.col("ts") > F.col("anchor"))
    bounds = dict(bounds or {})
    low, high = bounds.get("gte"), bounds.get("lte")
    clock = durations.instant(filters.get("asOf", now), "now")
    if agg == "recency_days":
        seen = rows.groupBy("passport_id").agg(F.max("ts").alias("matched_at"))
        if low is not None:
            seen = seen.filter(F.col("matched_at") <= durations.shift(clock, f"{low}d", -1))
        return seen if high is None else seen.filter(F.col("matched_at") >= durations.shift(clock, f"{high}d", -1))
    by = W.partitionBy("passport_id")
    if agg == "distinct_sessions":
        rows = rows.filter(F.col("session_id").isNotNull()).groupBy("passport_id", "session_id").agg(F.min(F.struct("ts", "id")).alias("_f")).select("passport_id", "_f.ts", "_f.id")
        step = F.lit(1.0)
    elif agg == "count":
        step = F.lit(1.0)
    elif agg == "sum_dwell_ms":
        step = F.coalesce(F.col("dwell_ms"), F.lit(0)).cast("double")
    else:
        value = exprs.attribute(rows.columns, bounds["field"])
        step = F.coalesce(value.try_cast("double") if f"attr_{bounds['field']}" in rows.columns else exprs.number(value), F.lit(0.0))
    if low is None:
        total = rows.groupBy("passport_id").agg(F.sum(step).alias("total"), F.max("ts").alias("matched_at"))
    else:
        running = F.sum(step).over(by.orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
        total = rows.withColumn("_step", step).withColumn("_run", running)
        total = total.groupBy("passport_id").agg(F.sum("_step").alias("total"), F.min(F.when(F.col("_run") >= low, F.col("ts"))).alias("matched_at"))
        total = total.filter(F.col("matched_at").isNotNull() & (F.col("total") >= low))
    return (total if high is None else total.filter(F.col("total") <= high)).select("passport_id", "matched_at")


# ---- grouped -----------------------------------------------------------------


def bucket(columns: list[str], by: str) -> Column:
    if by in GRAINS:
        return exprs.bucket_of_time(by, F.col("ts"))
    if by in ("channel", "direction", "source"):
        return F.col(by)
    if by == "content":
        return F.col("content_id")
    if by == "content_url":
        return exprs.canonical_url(F.col("content_url"))
    if by == "content_hash":
        return F.col("content_hash")
    kind, _, key = by.partition(":")
    exprs.refuse_contact_key(key)
    if kind == "session" and key in SESSION_KEYS:
        return F.col(key)
    if kind == "attr":
        return exprs.attribute(columns, key)
    if kind == "fact":
        return F.col("_fact")
    raise SpecError(f'group: cannot group by "{by}"')


def aggregate(columns: list[str], agg: str, given) -> Column:
    """The aggregate over one bucket; sums of nothing are 0, other values of nothing stay null."""
    given = given if isinstance(given, dict) else {}
    if agg == "count":
        return F.count(F.lit(1))
    if agg == "distinct_sessions":
        return F.count_distinct("session_id")
    if agg == "distinct_passports":
        return F.count_distinct("passport_id")
    if agg == "sum_dwell_ms":
        return F.coalesce(F.sum("dwell_ms"), F.lit(0))
    if agg in ("first_seen", "last_seen"):
        return F.date_format((F.min if agg == "first_seen" else F.max)("ts"), "yyyy-MM-dd HH:mm:ss")
    value = measure(columns, agg, given)
    if agg in ("earliest", "latest"):
        return F.round((F.min_by if agg == "earliest" else F.max_by)(value, F.struct("ts", "id")), 4)
    ways = {"sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)), "avg": lambda: F.avg(value), "min": lambda: F.min(value), "max": lambda: F.max(value)}
    return F.round(ways[agg](), 4)


def measure(columns: list[str], agg: str, given) -> Column:
    """The number of a row that an aggregate is of."""
    given = given if isinstance(given, dict) else {}
    if sum(k in given for k in ("field", "column", "fact")) != 1:
        raise SpecError(f"group: {agg} needs one of field, column, fact")
    if "column" in given:
        return F.col(given["column"]).cast("double")
    if "fact" in given:
        return F.col("_measure")
    raw = exprs.attribute(columns, given["field"])
    return raw.try_cast("double") if f"attr_{given['field']}" in columns else exprs.number(raw)


def folded(rows: DataFrame, names: list[str], agg: str, given) -> DataFrame:
    """names and value: the aggregate of each group; percentiles by counts, not by gathering a group's values."""
    if agg in ("median", "percentile"):
        p = 0.5 if agg == "median" else float(given.get("p", 0.5))
        return ranks.percentiles(rows, names, measure(rows.columns, agg, given), p)
    return rows.groupBy(*names).agg(aggregate(rows.columns, agg, given).alias("value"))


def group(events: DataFrame, spec: dict, by: str, now: str, facts: DataFrame | None = None, cohort: DataFrame | None = None, band: float | None = None, use: str = "last", limit: int | None = None, order: str | None = None) -> DataFrame:
    """(bucket, value) of one aggregate.

    A null bucket is a bucket.  A fact aggregate takes each person's value once a bucket.  `limit` keeps the most recent buckets
    of a time grain, else the largest values; `order` (value/bucket) overrides which.
    """
    filters, agg, given = split(spec, GROUPED)
    rows = apply_filters(events, filters, now, facts)
    if cohort is not None:
        rows = rows.join(cohort.select("passport_id").distinct(), "passport_id", "left_semi")
    key = _with_fact(rows, facts, by, use, filters.get("asOf"), band)
    rows, label = key
    if (filters.get("window") or {}).get("missingAnchor") == "bucket":
        label = F.when(F.col("anchored"), label).otherwise(F.lit(NO_ANCHOR))
    rows = rows.withColumn("bucket", label)
    if isinstance(given, dict) and "fact" in given:
        measure = fact_ops.current(facts, given["fact"], given.get("use", "last"), filters.get("asOf")).select("passport_id", F.col("num").alias("_measure"))
        rows = rows.select("passport_id", "bucket").distinct().join(measure, "passport_id", "left")
    out = folded(rows, ["bucket"], agg, given)
    if limit is None:
        return out
    return top(out, limit, order or ("bucket" if by in GRAINS else "value"))


def _with_fact(rows: DataFrame, facts: DataFrame | None, by: str, use: str, as_of: str | None, band: float | None) -> tuple[DataFrame, Column]:
    if not by.startswith("fact:"):
        if band:
            raise SpecError("group: band needs a fact bucket")
        return rows, bucket(rows.columns, by)
    exprs.refuse_contact_key(by[5:])
    held = fact_ops.current(facts, by[5:], use, as_of)
    label = exprs.band(F.col("num"), band) if band else F.col("value")
    return rows.join(held.select("passport_id", label.alias("_fact")), "passport_id", "left"), F.col("_fact")


def top(series: DataFrame, limit: int, order: str = "value") -> DataFrame:
    if order not in ("value", "bucket"):
        raise SpecError(f"group: order must be value or bucket, not {order!r}")
    return series.orderBy(F.col(order).desc_nulls_last(), F.col("bucket").asc_nulls_last()).limit(limit)


def cross_tab(events: DataFrame, spec: dict, by: tuple[str, str], now: str, facts: DataFrame | None = None, limit: int = 200, series_limit: int = 6, use: str = "last", band: float | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """(bucket, series, value) for two dimensions, each cut to its largest members by the same aggregate.

    A fact aggregate takes each person's value once a cell, and once a member where members are ranked.
    """
    rows, once_a_person, agg, given = _crossed(events, spec, by, now, facts, use, band, cohort)

    def totals_of(*names: str) -> DataFrame:
        return folded(once_a_person(rows, names), list(names), agg, given)

    def kept(name: str, n: int, recent: bool) -> DataFrame:
        totals = totals_of(name)
        first = F.col(name).desc_nulls_last() if recent else F.col("value").desc_nulls_last()
        return totals.orderBy(first, F.col(name).asc_nulls_last()).limit(n).select(F.col(name).alias(f"_{name}"))

    cells = totals_of("bucket", "series")
    for name, n, b in (("bucket", limit, by[0]), ("series", series_limit, by[1])):
        best = kept(name, n, b in GRAINS)
        cells = cells.join(F.broadcast(best), F.col(name).eqNullSafe(F.col(f"_{name}")), "left_semi")  # at most n rows
    return cells


def _crossed(events: DataFrame, spec: dict, by: tuple[str, str], now: str, facts: DataFrame | None, use: str, band: float | None, cohort: DataFrame | None):
    """The rows with their bucket and series, what of them a grouping by some of the two aggregates, the aggregate and what it is given."""
    filters, agg, given = split(spec, GROUPED)
    rows = apply_filters(events, filters, now, facts)
    if cohort is not None:
        rows = rows.join(cohort.select("passport_id").distinct(), "passport_id", "left_semi")
    for name, b in zip(("bucket", "series"), by, strict=True):
        rows, label = _with_fact(rows, facts, b, use, filters.get("asOf"), band if b.startswith("fact:") else None)
        rows = rows.withColumn(name, label).drop("_fact")

    def once_a_person(of: DataFrame, names: tuple[str, ...]) -> DataFrame:
        if isinstance(given, dict) and "fact" in given:
            value = fact_ops.current(facts, given["fact"], given.get("use", "last"), filters.get("asOf")).select("passport_id", F.col("num").alias("_measure"))
            return of.select("passport_id", *names).distinct().join(value, "passport_id", "left")
        return of

    return rows, once_a_person, agg, given


def cross_tab_extent(events: DataFrame, spec: dict, by: tuple[str, str], now: str, facts: DataFrame | None = None, series_limit: int = 6, use: str = "last", band: float | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """One row beside a cross-tab: shown and all series, whether some are cut, and the people behind all of it."""
    rows, *_ = _crossed(events, spec, by, now, facts, use, band, cohort)
    sizes = rows.agg(F.count_distinct(F.struct("series")).alias("series"), F.count_distinct("passport_id").alias("cohort_size"))
    return sizes.select(F.least("series", F.lit(series_limit)).alias("shown"), "series", (F.col("series") > series_limit).alias("truncated"), "cohort_size")


def anchor_cross_tab(events: DataFrame, spec: dict, by: str, now: str, facts: DataFrame) -> DataFrame:
    """(bucket, anchored, value, people) of those with an anchor, within the window, and those without."""
    filters, agg, given = split(spec, GROUPED)
    filters = {**filters, "window": {**filters["window"], "missingAnchor": "bucket"}}
    rows = apply_filters(events, filters, now, facts)
    rows = rows.withColumn("bucket", bucket(rows.columns, by))
    if agg in ("median", "percentile"):
        raise SpecError("group: no percentile beside the people of a window")
    return rows.groupBy("bucket", "anchored").agg(aggregate(rows.columns, agg, given).alias("value"), F.count_distinct("passport_id").alias("people"))


def cohort_size(events: DataFrame, spec: dict, now: str, facts: DataFrame | None = None) -> DataFrame:
    """People behind a series, before any limit."""
    filters, _, _ = split(spec, GROUPED)
    return apply_filters(events, filters, now, facts).agg(F.count_distinct("passport_id").alias("cohort_size"))
