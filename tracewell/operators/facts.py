"""Facts: current and as-of values, value predicates, questions about history."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import durations, exprs
from ..functions.durations import SpecError

VALUE_OPS = ("eq", "ne", "in", "gt", "gte", "lt", "lte", "contains", "startsWith", "endsWith", "present", "next", "last", "before")
HISTORY_OPS = ("changed", "transition", "increased", "decreased", "held", "distinct")
USES = ("last", "first", "max", "min")
# What people write for an operator that has another name.
HINTS = {"exists": "present", "isNull": "present: false", "isset": "present", "has": "present", "matches": "contains", "equals": "eq", "not": "ne", "neq": "ne", "ge": "gte", "le": "lte", "like": "contains", "starts": "startsWith", "ends": "endsWith", "since": "last"}


def of_key(facts: DataFrame, key: str, as_of: str | None = None) -> DataFrame:
    rows = facts.filter(F.col("key") == key)
    return rows if as_of is None else rows.filter(F.col("observed_at") <= durations.instant(as_of, "asOf"))


def current(facts: DataFrame, key: str, use: str = "last", as_of: str | None = None) -> DataFrame:
    """One row for each passport: passport_id, value, num, at, observed_at.

    The newest row wins, ties by id; `first` takes the oldest, `max` and `min` the extreme value, numbers before
    texts as numbers.  Folds in the map tasks, so a passport with a long history costs no sort.
    """
    newest, oldest = F.struct("observed_at", "id"), F.struct("observed_at", "id")
    sort_value = F.struct(F.col("num").isNotNull(), F.coalesce("num", F.lit(0.0)), F.col("value"))
    row = F.struct("value", "num", "at", "observed_at", "id")
    back = F.struct((-F.unix_micros("observed_at")).alias("o"), (-F.col("id")).alias("i"))
    pick = {
        "last": lambda: F.max_by(row, newest),
        "first": lambda: F.min_by(row, oldest),
        "max": lambda: F.max_by(row, F.struct(sort_value.alias("v"), newest.alias("n"))),
        "min": lambda: F.min_by(row, F.struct(sort_value.alias("v"), back.alias("n"))),
    }
    if use not in pick:
        raise SpecError(f"fact: use must be one of {'/'.join(USES)}, not {use!r}")
    rows = of_key(facts, key, as_of)
    if use in ("max", "min"):
        rows = rows.filter(F.col("value").isNotNull())
    return rows.groupBy("passport_id").agg(pick[use]().alias("f")).select("passport_id", "f.value", "f.num", "f.at", "f.observed_at")


def history(facts: DataFrame, key: str) -> DataFrame:
    by = W.partitionBy("passport_id").orderBy("observed_at", "id")
    return of_key(facts, key).withColumns({"previous": F.lag("value").over(by), "previous_num": F.lag("num").over(by), "place": F.row_number().over(by)})


def _number(bound) -> float | None:
    if isinstance(bound, bool):
        return None
    if isinstance(bound, (int, float)):
        return float(bound)
    return float(bound) if isinstance(bound, str) and re.match(exprs.NUMERIC, bound) else None


def _equal(value: Column, num: Column, bound) -> Column:
    same = value == F.lit(str(bound).lower() if isinstance(bound, bool) else str(bound))
    n = _number(bound)
    return same if n is None else same | (num == n)


def _compare(value: Column, num: Column, op: str, bound) -> Column:
    """As numbers if both are, else as dates if both are, else as texts."""
    test = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
    n, text = _number(bound), F.lit(str(bound))
    if n is None:
        return _dated(test, value, text)
    return F.when(num.isNotNull(), test(num, F.lit(n))).otherwise(test(value, text))


def _dated(test, a: Column, b: Column) -> Column:
    """As dates if both are, else as texts."""
    one, two = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(one.isNotNull() & two.isNotNull(), test(one, two)).otherwise(test(a, b))


def _strictly(value: Column, num: Column, bound) -> Column:
    """Equal without conversion: numbers to numbers, texts to texts."""
    if isinstance(bound, (int, float)) and not isinstance(bound, bool):
        return num == F.lit(float(bound))
    return value == F.lit(str(bound).lower() if isinstance(bound, bool) else str(bound))


def value_predicate(ops: dict, now: str | None = None, value: Column | None = None, num: Column | None = None) -> Column:
    """Whether a value meets all operators; an absent value meets none but present: false."""
    value, num = F.col("value") if value is None else value, F.col("num") if num is None else num
    out = F.lit(True)
    low = F.lower(value)
    for op, bound in ops.items():
        if op not in VALUE_OPS:
            hint = f' (did you mean "{HINTS[op]}"?)' if op in HINTS else f" (use {'/'.join(VALUE_OPS)})"
            raise SpecError(f'fact: unknown operator "{op}"{hint}')
        if op == "eq":
            test = _equal(value, num, bound)
        elif op == "ne":
            test = ~_equal(value, num, bound)
        elif op == "in":
            test = F.lit(False)
            for b in bound:
                test = test | F.coalesce(_equal(value, num, b), F.lit(False))
        elif op in ("gt", "gte", "lt", "lte"):
            test = _compare(value, num, op, bound)
        elif op == "contains":
            test = F.contains(low, F.lit(str(bound).lower()))
        elif op == "startsWith":
            test = F.startswith(low, F.lit(str(bound).lower()))
        elif op == "endsWith":
            test = F.endswith(low, F.lit(str(bound).lower()))
        elif op == "present":
            test = value.isNotNull() if bound else value.isNull()
            out = out & test
            continue
        else:
            if now is None:
                raise SpecError(f"fact: {op} needs a clock")
            clock, at = durations.instant(now, "now"), F.try_to_timestamp(value)
            test = {"next": lambda: at.between(clock, durations.shift(clock, bound)), "last": lambda: at.between(durations.shift(clock, bound, -1), clock), "before": lambda: at < (durations.shift(clock, bound, -1) if re.fullmatch(r"\d+[a-zA-Z]", str(bound)) else durations.instant(bound, "before"))}[op]()
        out = out & value.isNotNull() & test
    return F.coalesce(out, F.lit(False))


def matching(facts: DataFrame, passports: DataFrame, key: str, ops: dict, now: str, as_of: str | None = None, use: str = "last", computed: dict | None = None, held: DataFrame | None = None) -> DataFrame:
    """(passport_id, matched_at) of those whose value, or history, meets all operators.

    matched_at is when the value was observed, or the latest time at which an operator on history held; it is null for
    an absence.  `computed` maps a key to {from, unit}: whole units from the date that it is derived from to now.  `held` are
    current values, one row for each passport and key, from which newest values are read without folding the log.
    """
    ops = dict(ops)
    use = ops.pop("use", use)
    past = {k: v for k, v in ops.items() if k in HISTORY_OPS}
    plain = {k: v for k, v in ops.items() if k not in HISTORY_OPS}
    found = [history_match(facts, key, op, spec, now) for op, spec in past.items()]
    if plain:
        source = (computed or {}).get(key)
        named = source["from"] if source else key
        rows = current(facts, named, use, as_of) if held is None or as_of is not None or use != "last" else held.filter(F.col("key") == named)
        if source:
            derived = exprs.age(source["unit"], F.coalesce("at", F.try_to_timestamp("value")), durations.instant(now, "now")).cast("double")
            rows = rows.withColumn("num", derived).withColumn("value", derived.cast("long").cast("string"))
        if plain.get("present") is False:
            joined = passports.select(F.col("id").alias("passport_id")).join(rows, "passport_id", "left")
            found.append(joined.filter(value_predicate(plain, now)).select("passport_id", F.lit(None).cast("timestamp").alias("matched_at")))
        else:
            found.append(rows.filter(value_predicate(plain, now)).select("passport_id", F.col("observed_at").alias("matched_at")))
    if not found:
        raise SpecError(f'fact "{key}" needs an operator')
    out = found[0]
    for other in found[1:]:
        out = out.join(other.withColumnRenamed("matched_at", "_other"), "passport_id").select("passport_id", F.when(F.col("matched_at").isNotNull() & F.col("_other").isNotNull(), F.greatest("matched_at", "_other")).alias("matched_at"))
    return out


def history_match(facts: DataFrame, key: str, op: str, spec, now: str) -> DataFrame:
    clock = durations.instant(now, "now")
    rows = history(facts, key)

    def recent(needed: bool) -> Column:
        last = spec.get("last") if isinstance(spec, dict) else None
        if last is None:
            if needed:
                raise SpecError(f'fact "{key}": {op} needs a window, {{ last: "30d" }}')
            return F.lit(True)
        return F.col("observed_at").between(durations.shift(clock, last, -1, f"{op}.last"), clock)

    differs = (F.col("place") > 1) & ~F.col("value").eqNullSafe(F.col("previous"))
    if op == "changed":
        hit = differs & recent(True)
    elif op == "transition":
        hit = differs & recent(True)
        if "from" in spec:
            hit = hit & F.coalesce(_strictly(F.col("previous"), F.col("previous_num"), spec["from"]), F.lit(False))
        if "to" in spec:
            hit = hit & F.coalesce(_strictly(F.col("value"), F.col("num"), spec["to"]), F.lit(False))
    elif op in ("increased", "decreased"):
        both = F.col("num").isNotNull() & F.col("previous_num").isNotNull()
        test = (lambda a, b: a > b) if op == "increased" else (lambda a, b: a < b)
        moved = F.when(both, test(F.col("num"), F.col("previous_num"))).otherwise(_dated(test, F.col("value"), F.col("previous")))
        hit = (F.col("place") > 1) & moved & recent(True)
    elif op == "held":
        ops = {k: v for k, v in spec.items() if k != "last"} if isinstance(spec, dict) else {"in": spec} if isinstance(spec, list) else {"eq": spec}
        hit = value_predicate(ops or {"present": True}, now) & recent(False)
    elif op == "distinct":
        return _distinct_held(rows.withColumn("_in", recent(False) & F.col("value").isNotNull()), spec if isinstance(spec, dict) else {"gte": spec})
    else:
        raise SpecError(f'fact: unknown operator "{op}"')
    return rows.filter(F.coalesce(hit, F.lit(False))).groupBy("passport_id").agg(F.max("observed_at").alias("matched_at"))


def _distinct_held(rows: DataFrame, spec: dict) -> DataFrame:
    """When the number of different values held (rows with _in) reached gte; without gte, the last observation.  None may exceed lte."""
    least, most = spec.get("gte"), spec.get("lte")
    seen = rows.groupBy("passport_id", F.when(F.col("_in"), F.col("value")).alias("value")).agg(F.min(F.struct("observed_at", "id")).alias("f"), F.max("observed_at").alias("last"))
    held = F.col("value").isNotNull()
    numbered = seen.withColumn("n", F.when(held, F.row_number().over(W.partitionBy("passport_id", held).orderBy("f"))).otherwise(0))
    reached = F.max("last") if least is None or least <= 0 else F.min(F.when(F.col("n") >= least, F.col("f.observed_at")))
    out = numbered.groupBy("passport_id").agg(F.max("n").alias("n"), reached.alias("matched_at")).filter("matched_at IS NOT NULL")
    return (out if most is None else out.filter(F.col("n") <= most)).select("passport_id", "matched_at")


def ambiguity(facts: DataFrame) -> DataFrame:
    """For each key: passports, passports that held several values, and the most values held."""
    held = facts.groupBy("key", "passport_id").agg(F.count_distinct("value").alias("n"))
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.max("n").alias("most_values"))


def discovery(facts: DataFrame) -> DataFrame:
    """For each key: rows, people, distinct values, numeric range."""
    return facts.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("passport_id").alias("people"), F.count_distinct("value").alias("n_values"), F.round(F.min("num"), 4).alias("low"), F.round(F.max("num"), 4).alias("high"))


SAMPLED, CATEGORICAL = 8, 25


def described(facts: DataFrame) -> DataFrame:
    """For each key: its most frequent type, its bounds as text, its first distinct values, and all of them if they are few.

    Bounds are those of the numbers if the key has any, else of the texts.  Values come in the order of texts.  Only the
    first values of each key are gathered, whatever number it has.
    """
    per_value = facts.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("key").orderBy("value"))
    first = per_value.filter("value IS NOT NULL").withColumn("place", place).filter(F.col("place") <= CATEGORICAL + 1)
    few = first.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("few"))
    types = facts.groupBy("key", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    bounds = facts.groupBy("key").agg(*[F.coalesce(f("num").cast("string"), f("value")).alias(name) for name, f in (("low", F.min), ("high", F.max))])
    joined = bounds.join(types, "key").join(few, "key", "left").withColumn("few", F.coalesce("few", F.array().cast("array<string>")))
    return joined.select("key", "type", "low", "high", F.slice("few", 1, SAMPLED).alias("sample"), F.when(F.size("few") <= CATEGORICAL, F.col("few")).alias("values"))


def without_restatements(rows: DataFrame) -> DataFrame:
    """Drop rows that restate the value before them; rows with an external_id always stay."""
    by = W.partitionBy("passport_id", "key").orderBy("observed_at", "id")
    same = F.col("value").eqNullSafe(F.lag("value").over(by)) & (F.row_number().over(by) > 1)
    if "external_id" in rows.columns:
        same = same & F.col("external_id").isNull()
    return rows.withColumn("_same", same).filter("NOT _same").drop("_same")


def news(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of a batch that are worth writing beside the held current values (passport_id, key, value, observed_at).

    A row without external_id that has the held value and is no older restates it and goes; a back-dated one stays.
    Objects are compared by content, whatever the order of their keys.
    """
    same = exprs.canonical_json(F.col("value")).eqNullSafe(exprs.canonical_json(F.col("_held"))) & (F.col("observed_at") >= F.col("_since"))
    known = held.select("passport_id", "key", F.col("value").alias("_held"), F.col("observed_at").alias("_since"))
    marked = batch.join(known, ["passport_id", "key"], "left")
    restated = F.coalesce(same & F.col("_since").isNotNull(), F.lit(False))
    if "external_id" in batch.columns:
        restated = restated & F.col("external_id").isNull()
    return marked.filter(~restated).select(*batch.columns)


def notes(facts: DataFrame, keys: list[str], declared: dict[str, str] | None = None, uses: dict[str, str] | None = None, anchors: dict[str, str | None] | None = None) -> DataFrame:
    """(fact, code, affected, percent, most_values, used): keys whose answer hangs on which of several values is taken.

    A declared key is settled unless it anchors a window.  `used` is the rule that ran: the anchor's, the query's, the
    declared one, or last.
    """
    declared, uses, anchors = declared or {}, uses or {}, anchors or {}
    checked = [k for k in dict.fromkeys(keys) if k not in declared or k in anchors]
    rules = [(k, "ambiguous_anchor_fact" if k in anchors else "ambiguous_fact_value", anchors.get(k) or uses.get(k) or declared.get(k) or "last") for k in checked]
    found = ambiguity(facts.filter(F.col("key").isin(checked))).filter("ambiguous > 0")
    table = facts.sparkSession.createDataFrame(rules, "fact string, code string, used string")  # one row for each key of the query
    percent = F.round(F.col("ambiguous") * 100.0 / F.col("people"), 1).alias("percent")
    return found.join(F.broadcast(table), F.col("key") == F.col("fact")).select("fact", "code", F.col("ambiguous").alias("affected"), percent, F.col("most_values"), "used")


def on_conflict(rows: DataFrame, policy: str, keys: list[str], arrival: str) -> DataFrame:
    """One row for each key: `skip` keeps the first to arrive, `replace` the last; `error` fails on a second."""
    others = F.struct(*[F.col(c) for c in rows.columns])
    if policy == "error":
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        checked = F.when(n > 1, F.raise_error(F.lit("conflicting rows"))).otherwise(F.lit(True))
        return rows.withColumn("_ok", checked).filter("_ok").drop("_ok")
    if policy not in ("skip", "replace"):
        raise SpecError(f"onConflict must be skip, replace or error, not {policy!r}")
    pick = F.min_by(others, F.col(arrival)) if policy == "skip" else F.max_by(others, F.col(arrival))
    return rows.groupBy(*keys).agg(pick.alias("_r")).select("_r.*")


def audit(projection: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Passports whose projected value is not the log's: full outer, nulls compared as values."""
    truth = current(log, key).select("passport_id", F.col("value").alias("expected"))
    return projection.select("passport_id", "value").join(truth, "passport_id", "full_outer").filter(~F.col("value").eqNullSafe(F.col("expected")))
