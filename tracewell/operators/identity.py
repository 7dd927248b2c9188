"""Identity: merge closure, claims to passports, erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import cut

MOST_HOPS = 48


def survivors(merges: DataFrame) -> DataFrame:
    """(absorbed, survivor): every absorbed id with the passport that it ends at.

    The newest merge of an id counts (column merged_at, if there is one).  Pointers double their reach each round, so
    a chain of n merges takes log n joins.
    """
    if "merged_at" in merges.columns:
        merges = merges.groupBy("absorbed").agg(F.max_by("survivor", "merged_at").alias("survivor"))
    ends = merges.select("absorbed", "survivor").filter("absorbed <> survivor")
    n = ends.count()
    for k in range(MOST_HOPS):
        if 2**k > 2 * max(n, 1):
            break  # longer than any chain of so many merges
        onward = ends.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("_next"))
        stepped = ends.join(onward, "survivor", "left").select("absorbed", F.coalesce("_next", "survivor").alias("survivor"), F.col("_next").isNotNull().alias("_moved"))
        stepped = cut(stepped, eager=True)  # the next round reads it twice
        if stepped.filter("_moved").isEmpty():
            return ends
        ends = stepped.drop("_moved")
    raise RuntimeError("merges do not end: they hold a cycle")


def resolve(rows: DataFrame, closure: DataFrame, column: str = "passport_id") -> DataFrame:
    """The rows with each absorbed id replaced by its survivor."""
    ends = closure.select(F.col("absorbed").alias(column), F.col("survivor").alias("_to"))
    return rows.join(ends, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def claims(identities: DataFrame) -> DataFrame:
    """(type, value, passport_id): a strong claim belongs to the passport that made it last."""
    return identities.groupBy("type", "value").agg(F.max_by("passport_id", F.struct("last_seen_at", "id")).alias("passport_id"))


# For so many whole days after it was last seen an identity still stands for its holder; None: for ever.
LIFESPANS = {"fingerprint": 7, "phone": 30, "email": 365, "user": None}
DAY = 86_400
MOST_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the ids of (a, b) that are connected have the smallest of them in common.

    Every id is hung below the smallest of its neighbours, first the larger ones, then the smaller ones, until
    nothing moves: some log n rounds, each two aggregates and joins without an id's neighbours in one place.
    """
    links = cut(edges.select("a", "b").filter("a <> b").distinct(), eager=True)
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    held = None
    for _ in range(MOST_HOPS):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = larger.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        links = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        links = cut(links, eager=True)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == held:
            found = links.groupBy("a").agg(F.min("b").alias("component"))
            return ids.join(found.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        held = now
    raise RuntimeError("components did not settle")


def sightings_within(identities: DataFrame, lifespans: dict[str, int | None] | None = None) -> DataFrame:
    """(a, b, seen_at, id): passport a showed an identity that b was the first to show, within its lifespan.

    Of each pair the first such sighting.  Only the first sighting of an identity on a day can be too late for the day before,
    so gaps are measured between days, and no window holds more of one identity than a row for each day.
    """
    days = LIFESPANS if lifespans is None else lifespans
    lives = F.coalesce(*[F.when(F.col("type") == kind, F.lit(2**31 if n is None else n)) for kind, n in days.items()], F.lit(0))
    rows = identities.select("type", "value", "passport_id", "seen_at", "id").withColumn("_lives", lives).filter("_lives > 0 AND value IS NOT NULL AND passport_id IS NOT NULL")
    rows = rows.withColumn("_day", F.floor(F.unix_timestamp("seen_at") / DAY))
    place = F.struct("seen_at", "id")
    by_day = rows.groupBy("type", "value", "_lives", "_day").agg(F.min(place).alias("f"), F.max("seen_at").alias("last"))
    before = F.lag("last").over(W.partitionBy("type", "value").orderBy("_day"))
    late = (F.unix_timestamp("f.seen_at") - F.unix_timestamp(before)) / DAY
    outside = by_day.withColumn("_late", F.floor(late)).filter("_late IS NULL OR _late > _lives").select("type", "value", "f.seen_at", "f.id")
    within = rows.join(outside, ["type", "value", "seen_at", "id"], "left_anti")
    shown = within.groupBy("type", "value", "passport_id").agg(F.min(place).alias("p"))
    first = rows.groupBy("type", "value").agg(F.min_by("passport_id", place).alias("b"))
    pairs = shown.join(first, ["type", "value"]).filter(F.col("passport_id") != F.col("b"))
    return pairs.groupBy(F.col("passport_id").alias("a"), "b").agg(F.min("p").alias("p")).select("a", "b", "p.seen_at", "p.id")


def _fold(a: list, b: list) -> list[tuple]:
    """(absorbed, survivor, last, place) of each edge, in order, that joins two groups: the group of b goes into that of a.

    `last` is where the absorbed id ends after all edges.
    """
    above: dict = {}

    def top(x):
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[y] = x
            out.append((y, x, k))
    return [(y, x, top(y), k) for y, x, k in out]


def _folded(edges: DataFrame, by: str) -> DataFrame:
    """Fold the edges of each group in the order of their sightings."""
    import pyarrow as pa

    kind = edges.schema["a"].dataType.simpleString()

    def fold(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("seen_at", "ascending"), ("id", "ascending")])
        made = _fold(rows["a"].to_pylist(), rows["b"].to_pylist())
        gone, stays, last = (pa.array([m[i] for m in made], rows["a"].type) for i in (0, 1, 2))
        at = rows["seen_at"].take(pa.array([m[3] for m in made], pa.int64()))
        return pa.table({"absorbed": gone, "survivor": stays, "last": last, "merged_at": at})

    return edges.groupBy(by).applyInArrow(fold, f"absorbed {kind}, survivor {kind}, last {kind}, merged_at timestamp")


def linked(identities: DataFrame, lifespans: dict[str, int | None] | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """(absorbed, survivor, merged_at): merges that sightings (type, value, passport_id, seen_at, id) of identities bring about.

    Whoever shows an identity within its lifespan after it was last seen absorbs its holder; both are resolved through all
    merges before that sighting, so nobody is absorbed twice and merges never end in a circle.  Later than the lifespan the
    holder stays and is left alone.  Kinds without a lifespan merge nobody; null values and passports stand for nobody.

    An identity's holder is always whoever its first passport has become, so only the first sighting of each pair of a passport and
    a first passport can merge.  These are folded in order of time, many components to a task.  A component of over
    most_edges is folded by slices of time of that size, each after the merges of those before it.
    """
    edges = cut(sightings_within(identities, lifespans), eager=True)
    groups = components(edges).withColumnRenamed("id", "a")
    named = edges.join(groups, "a")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    named = cut(named.join(sizes, "component"), eager=True)
    small, large = named.filter(F.col("_n") <= most_edges), named.filter(F.col("_n") > most_edges)
    tasks = max(1, -(-4 * small.count() // most_edges))
    merges = _folded(small.withColumn("_task", F.pmod(F.xxhash64("component"), F.lit(tasks))), "_task").drop("last")
    slices = -(-large.count() // most_edges)
    return merges if not slices else merges.unionByName(_folded_by_time(large, slices))


def _folded_by_time(edges: DataFrame, slices: int) -> DataFrame:
    dealt = cut(edges.repartitionByRange(slices, "seen_at", "id").withColumn("_slice", F.spark_partition_id()), eager=True)
    moved, out = None, None
    for k in range(slices):
        part = dealt.filter(F.col("_slice") == k).select("a", "b", "seen_at", "id", "component")
        if moved is not None:
            part = resolve(resolve(part, moved, "a"), moved, "b").filter("a <> b")
        merges = cut(_folded(part, "component"), eager=True)
        ends = merges.select("absorbed", F.col("last").alias("survivor"))
        moved = ends if moved is None else cut(resolve(moved, ends, "survivor").unionByName(ends), eager=True)  # read twice by the next slice
        made = merges.drop("last")
        out = made if out is None else out.unionByName(made)
    return out


def erase(rows: DataFrame, gone: DataFrame, column: str = "passport_id") -> DataFrame:
    return rows.join(gone.select(F.col("passport_id").alias(column)), column, "left_anti")


def orphans(chunks: DataFrame, exposures: DataFrame) -> DataFrame:
    """Chunks whose content no exposure refers to any more."""
    return chunks.join(exposures.select("content_hash").distinct(), "content_hash", "left_anti")
