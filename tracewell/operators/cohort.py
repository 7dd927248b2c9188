"""Boolean trees over facts and event gates, as one lazy table of (passport_id, matched_at)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import SpecError
from ..sources.session import cut
from . import facts as fact_ops
from . import metrics

NODES = ("all", "any", "not", "fact", "metric")


@dataclass
class World:
    """What a selector can ask about, and its clock."""

    passports: DataFrame
    events: DataFrame
    facts: DataFrame
    now: str
    visits: DataFrame | None = None
    exposures: DataFrame | None = None
    computed: dict = field(default_factory=dict)
    uses: dict = field(default_factory=dict)
    held: DataFrame | None = None

    def rows_for(self, spec: dict, by: object = None) -> DataFrame:
        """Events joined to content or sessions only where the query needs it."""
        if metrics.needs_session(spec, by) and self.visits is not None:
            return self.visits
        named = by if isinstance(by, (list, tuple)) else [by]
        if (spec.get("content") is not None or "content_url" in named) and self.exposures is not None:
            return self.exposures
        return self.events


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both; the later time, or none if either has none."""
    b = b.select("passport_id", F.col("matched_at").alias("_other"))
    both = F.col("matched_at").isNotNull() & F.col("_other").isNotNull()
    return a.join(b, "passport_id").select("passport_id", F.when(both, F.greatest("matched_at", "_other")).alias("matched_at"))


def union(parts: list[DataFrame]) -> DataFrame:
    """Either; the earliest time that there is."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("passport_id").agg(F.min("matched_at").alias("matched_at"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("passport_id"), "passport_id", "left_anti")


def universe(world: World) -> DataFrame:
    return world.passports.select(F.col("id").alias("passport_id"), F.lit(None).cast("timestamp").alias("matched_at"))


def validate(node: dict) -> None:
    """One key a node, known keys only; an unknown clause is an error, never dropped."""
    if not isinstance(node, dict):
        raise SpecError(f"filter: a node is an object, not {node!r}")
    if not node:
        return
    if len(node) != 1 or next(iter(node)) not in NODES:
        raise SpecError(f"filter: a node has one key of {'/'.join(NODES)}, not {sorted(node)}")
    kind, body = next(iter(node.items()))
    if kind in ("all", "any"):
        if not isinstance(body, list):
            raise SpecError(f"filter: {kind} takes a list")
        for child in body:
            validate(child)
    elif kind == "not":
        validate(body)
    elif not isinstance(body, dict):
        raise SpecError(f"filter: {kind} takes an object")


def evaluate(world: World, node: dict, after: DataFrame | None = None) -> DataFrame:
    """(passport_id, matched_at); an empty filter is everyone.  `after` re-anchors metric gates."""
    validate(node)
    if not node:
        return universe(world)
    kind, body = next(iter(node.items()))
    if kind == "all":
        positive = [n for n in body if "not" not in n]
        out = evaluate(world, positive[0], after) if positive else universe(world)
        for n in positive[1:]:
            out = intersect(out, evaluate(world, n, after))
        for n in body:
            if "not" in n:
                out = minus(out, evaluate(world, n["not"], after))
        return out
    if kind == "any":
        return union([evaluate(world, n, after) for n in body]) if body else universe(world).filter(F.lit(False))
    if kind == "not":
        return minus(universe(world), evaluate(world, body, after))
    if kind == "fact":
        parts = [fact_ops.matching(world.facts, world.passports, key, ops if isinstance(ops, dict) else {"eq": ops}, world.now, use=world.uses.get(key, "last"), computed=world.computed, held=world.held) for key, ops in body.items()]
        out = parts[0]
        for p in parts[1:]:
            out = intersect(out, p)
        return out
    return metrics.gate(world.rows_for(body), body, world.now, world.facts, after)


def people(world: World, selector: dict, scope: DataFrame | None = None) -> DataFrame:
    """(passport_id, matched_at) of a selector's filter, within a scope if there is one."""
    found = evaluate(world, selector.get("filter") or {})
    return found if scope is None else found.join(scope.select("passport_id"), "passport_id", "left_semi")


def count(world: World, selector: dict) -> DataFrame:
    return people(world, selector).agg(F.count_distinct("passport_id").alias("n"))


# ---- ordered funnels ---------------------------------------------------------------------------


def has_metric(node: dict) -> bool:
    kind, body = next(iter(node.items()), ("", None))
    return kind == "metric" or kind in ("all", "any") and any(map(has_metric, body)) or kind == "not" and has_metric(body)


def funnel(world: World, steps: list[dict], within: str | None = None, named: dict | None = None) -> list[DataFrame]:
    """For each step its (passport_id, anchor).

    A step {name, filter, within?} keeps survivors of the step before.  With `within` the event must come later than
    the last anchor and no later than that much after it; without, membership is enough and the anchor moves if
    the step has a time.  Metric gates, also within all, any and not, count only what came after the anchor.  The funnel's own `within` bounds the
    time from the first step to the last.
    """
    from ..functions import durations

    out: list[DataFrame] = []
    for k, step in enumerate(steps):
        node = (named or {})[step["use"]] if "use" in step else step["filter"]
        if k == 0:
            out.append(evaluate(world, node).select("passport_id", F.col("matched_at").alias("anchor"), F.col("matched_at").alias("began")))
            continue
        before = out[-1]
        timed = "within" in step
        found = evaluate(world, node, before.select("passport_id", "anchor").filter("anchor IS NOT NULL") if has_metric(node) else None)
        joined = before.join(found, "passport_id")
        if timed:
            joined = joined.filter((F.col("matched_at") > F.col("anchor")) & (F.col("matched_at") <= durations.shift(F.col("anchor"), step["within"], 1, "within")))
        out.append(cut(joined.select("passport_id", F.coalesce("matched_at", "anchor").alias("anchor"), "began")))  # read twice by the next step
    if within:
        out[-1] = out[-1].filter(F.col("anchor") <= durations.shift(F.col("began"), within, 1, "within"))
    return out


def funnel_report(world: World, steps: list[dict], within: str | None = None, named: dict | None = None) -> DataFrame:
    """(step, name, n, step_conversion, overall) with percentages of the step before and of the first."""
    parts = funnel(world, steps, within, named)
    out = None
    for k, (step, df) in enumerate(zip(steps, parts, strict=True)):
        row = df.agg(F.count_distinct("passport_id").alias("n")).select(F.lit(k).alias("step"), F.lit(step.get("name", f"step {k + 1}")).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    from pyspark.sql import Window as W

    order = W.partitionBy(F.lit(0)).orderBy("step")  # one row for each step
    share = lambda base: F.round(F.when(base > 0, F.col("n") * 100.0 / base).otherwise(0.0), 4)
    return out.withColumn("step_conversion", share(F.lag("n", 1).over(order))).withColumn("step_conversion", F.when(F.col("step") == 0, 100.0).otherwise(F.col("step_conversion"))).withColumn("overall", share(F.first("n").over(order)))


def gap(world: World, steps: list[dict], k: int, named: dict | None = None) -> DataFrame:
    """(passport_id, status) of those who reached step k but not k + 1: pending while its window is open, else dropped."""
    from ..functions import durations

    parts = funnel(world, steps[: k + 2], None, named)
    left = parts[k].join(parts[k + 1].select("passport_id"), "passport_id", "left_anti")
    limit = steps[k + 1].get("within")
    clock = durations.instant(world.now, "now")
    over = F.lit(False) if limit is None else clock > durations.shift(F.col("anchor"), limit, 1, "within")
    return left.select("passport_id", F.when(F.coalesce(over, F.lit(False)), "dropped").otherwise("pending").alias("status"))
