"""Exact n-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set is its distinct shingles.  Documents with one set are a class, joined once.  With
a threshold of t, sets of a and b shingles link when they share c(a, b) = ceil(t (a + b) / (1 + t)).

Small sets enumerate their subsets of size c for every size of partner; a common subset is a link,
so a key's members are tied to its least member and never paired.  The largest small size is
where enumerating costs less than scanning, both counted on the data.

Large sets scan inverted lists.  Only lists of a set's rarest shingles can be needed (the prefix
filter): the order is document frequency, then hash, within the lower part of the hash range, and
hash beyond.  Sets that meet in a list are joined into candidate groups, and a set's text is sent
where its group is: a task builds the lists of all shingles it has, and each set scans its lists to
count its overlap with every other at once.  It returns stars of what is linked, never the links.

A group of more sets than a task takes is cut into blocks.  Each block links its own sets, then the
heads of what came out are linked among each other, which leaves a group of copies with one large
part.  Only the sets outside the largest part (visitors) still go to the other blocks, in blocks of
their own, to meet the sets of other parts there.  So a group of G sets with S visitors costs
G * S / block set copies; where nothing links and everything is a candidate, S is G, and that is a
square, though in tasks of bounded size and without pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import contract, fold
from .session import checkpoint, shuffle_width
from .textvec import U64, Slice, mix, run_hash, run_prefix, signed, slices, text_of

WORDS = 5
PERCENT = 75
LARGEST_SMALL = 12
KEPT_RANGE = 0.5
BLOCK = 400
NO_ID = 2**63 - 1
SETS = "row_key long, doc_id long, set_key long, n_shingles long, small array<long>, frequent array<struct<token: long, n: long>>"
TOKENS = "token long, set_key long, n long, in_range long, salt int"
EDGES = "a long, b long"
HOT = 2**62
STRETCH = 250_000  # shingles


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def shingles(s: Slice, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, ascending, and each row's first; a short row is one shingle."""
    s.find_words()
    prefix = run_prefix(s.hash_words(lower=True))
    n = len(s.start)
    at = np.arange(n)
    end = s.first[1:][s.doc] if n else at
    begin = s.first[:-1][s.doc] if n else at
    use = (at + words <= end) | (at == begin)
    at = at[use]
    h, doc = run_hash(prefix, at, np.minimum(at + words, end[use])), s.doc[use]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    first = np.zeros(s.rows + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=s.rows), out=first[1:])
    return h, first


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(0xA0761D6478BD642F)), out=total[1:])
    return signed(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)))


def describe(words: int, width: int):
    """Each row's set: key, size, the shingles if they are few, and at a batch's first row the batch's frequent shingles.

    Frequent are those with a 4 * width-th or more of the shingles of a stretch of texts: a shingle with as large a share of
    all shingles has it in some stretch.
    """

    def often(tokens: list[np.ndarray]) -> list[dict]:
        found, times = np.unique(np.concatenate(tokens), return_counts=True)
        at = np.flatnonzero(times >= max(2, times.sum() / (4 * width)))
        return [{"token": t, "n": c} for t, c in zip(found[at].tolist(), times[at].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stretch, reported, found = [], [], []
            for s in slices(text_of(batch.column(2))):
                h, first = shingles(s, words)
                n = np.diff(first)
                found.append((set_keys(h, first), n, _small(h, first, n)))
                stretch.append(signed(h))
                if sum(map(len, stretch)) > STRETCH:
                    reported += often(stretch)
                    stretch = []
            reported += often(stretch) if stretch else []
            keys, n, small = (np.concatenate([x[k] for x in found]) if k < 2 else [y for x in found for y in x[k]] for k in range(3))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array(n), pa.array(small, pa.list_(pa.int64())), pa.array([reported] + [None] * (batch.num_rows - 1), pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())])))],
                names=["row_key", "doc_id", "set_key", "n_shingles", "small", "frequent"],
            )

    return run


def _small(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[list[int] | None]:
    out: list[list[int] | None] = [None] * len(n)
    for i in np.flatnonzero((n > 0) & (n <= LARGEST_SMALL)).tolist():
        out[i] = signed(h[first[i] : first[i + 1]]).tolist()
    return out


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, first, keys, rows) of slices; rows are those whose set did not come earlier in the batch."""
    for batch in batches:
        seen: set[int] = set()
        for s in slices(text_of(batch.column(0))):
            h, first = shingles(s, words)
            keys = set_keys(h, first)
            rows = [i for i, k in enumerate(keys.tolist()) if first[i] < first[i + 1] and not (k in seen or seen.add(k))]
            yield h, first, keys, np.array(rows, np.int64)


def large_tokens(words: int, least: int, percent: int, kept: float, hot: dict[int, int]):
    """The shingles of a set that its prefix can hold: those in the lower part of the hash range, or as many as the prefix has.

    hot says over how many lists a shingle's list is dealt; the others have one.
    """
    edge = U64(int(kept * 2**64))
    hot_tokens = np.array(sorted(hot), np.int64)
    ways = np.array([hot[t] for t in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, first, keys, rows in _distinct_sets(batches, words):
            rows = rows[np.diff(first)[rows] >= least]
            n = np.diff(first)[rows]
            below = np.zeros(len(h) + 1, np.int64)
            np.cumsum(h < edge, out=below[1:])
            in_range = below[first[1:][rows]] - below[first[:-1][rows]]
            take_n = np.maximum(in_range, n - -(-percent * n // 100) + 1)
            take = np.repeat(first[rows], take_n) + np.arange(take_n.sum()) - np.repeat(np.cumsum(take_n) - take_n, take_n)
            token, key, salt = signed(h[take]), np.repeat(keys[rows], take_n), np.full(len(take), -1, np.int64)
            if len(hot_tokens):
                at = np.minimum(np.searchsorted(hot_tokens, token), len(hot_tokens) - 1)
                is_hot = hot_tokens[at] == token
                salt[is_hot] = key[is_hot] % ways[at[is_hot]]
            yield pa.record_batch(
                [pa.array(token), pa.array(key), pa.array(np.repeat(n, take_n)), pa.array(np.repeat(in_range, take_n)), pa.array(salt.astype(np.int32))],
                names=["token", "set_key", "n", "in_range", "salt"],
            )

    return run


def small_subsets(largest: int, percent: int):
    """(subset, side, set_key): for each size of partner the subsets whose possession by both is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key, small in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(small, np.int64).view(U64)
                n = len(own)
                for m in partners(n, percent):
                    if 1 <= m <= largest:
                        picks = np.array(list(combinations(range(n), needed(n, m, percent))))
                        salt = mix(np.array([min(n, m) * 1000 + max(n, m)], U64))
                        codes = mix(mix(own ^ salt)[picks].sum(axis=1, dtype=U64))
                        out += [(c, int(n > m), key) for c in signed(codes).tolist()]
                        if n == m:
                            out += [(c, 1, key) for c in signed(codes).tolist()]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=["subset", "side", "set_key"])

    return run


def folded_by(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """A groupBy for a join back on its key: as it is dealt by another key, the join's exchanges are plain and Spark can split them."""
    out = df.groupBy(F.bitwise_not(key).alias("_key")).agg(*[x.alias(name) for name, x in aggregates.items()])
    return out.select(F.bitwise_not("_key").alias(key), *aggregates)


def choose_boundary(classes: DataFrame, percent: int = PERCENT) -> int:
    """The largest size of small sets: least cost of enumerating up to it and scanning beyond."""
    tokens = classes.filter(F.col("n_shingles") <= LARGEST_SMALL).select(F.col("n_shingles").alias("n"), F.explode("small").alias("token"))
    by_size = tokens.groupBy("token", "n").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("df"), F.collect_list(F.struct("n", "c")).alias("parts"))
    cost = by_size.select("df", F.inline("parts")).groupBy("n").agg(F.sum(F.col("df") * F.col("c")).alias("scan"), F.sum("c").alias("tokens"))
    sizes = {r["n"]: (r["scan"], r["tokens"] // r["n"]) for r in cost.collect()}  # one row for each small size
    best = None
    for boundary in range(LARGEST_SMALL + 1):
        total = sum(
            sets * sum(comb(n, needed(n, m, percent)) for m in partners(n, percent) if 1 <= m <= boundary) if n <= boundary else scan
            for n, (scan, sets) in sizes.items()
        )
        if best is None or total < best[0]:
            best = total, boundary
    return best[1]


def small_links(classes: DataFrame, largest: int, percent: int) -> DataFrame:
    keyed = classes.filter(F.col("n_shingles") <= largest).select("set_key", "small").mapInArrow(small_subsets(largest, percent), "subset long, side int, set_key long")
    low = F.min(F.when(F.col("side") == 0, F.col("set_key")))
    high = F.min(F.when(F.col("side") == 1, F.col("set_key")))
    least = folded_by(keyed, "subset", _low=low, _high=high).filter("_low IS NOT NULL AND _high IS NOT NULL")
    return keyed.join(least, "subset").select(F.col("set_key").alias("a"), F.when(F.col("side") == 0, F.col("_high")).otherwise(F.col("_low")).alias("b"))


def hot_tokens(sets: DataFrame, width: int) -> dict[int, int]:
    """Shingles with about a quarter of a partition's share of all shingles or more, and over how many lists each is dealt.

    What stretches of text report of a shingle is more than its part of that share, unless it has less than twice the share; so at
    most 4 * width shingles are hot, and a list beyond them is no longer than half a partition.
    """
    share = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] / (4 * width)
    reported = sets.filter("frequent IS NOT NULL").select(F.inline("frequent")).groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: 2 + int(r["n"] / share) for r in reported.filter(F.col("n") >= share).collect()}


def candidate_prefixes(tokens: DataFrame, width: int, percent: int, kept: float) -> DataFrame:
    """(token, set_key): each set's lists that the prefix filter leaves; hot shingles come last in the order."""
    edge = int(kept * 2**64)
    within = F.when(F.col("token") >= 0, F.col("token") < edge if edge < 2**63 else F.lit(True)).otherwise(F.lit(edge > 2**63) & (F.col("token") < edge - 2**64))
    dealt = tokens.repartition(width, "token", "salt").distinct()
    by_list = W.partitionBy("token", "salt")
    common = dealt.withColumn("_df", F.when(F.col("salt") >= 0, F.lit(HOT)).otherwise(F.count(F.lit(1)).over(by_list))).filter("_df > 1")
    by_set = W.partitionBy("set_key")
    order = by_set.orderBy(F.when(within, F.col("_df")).otherwise(F.lit(NO_ID)), F.col("token") < 0, "token")
    single = F.col("in_range") - F.count_if(within).over(by_set)
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - single
    return common.withColumns({"_room": room, "_at": F.row_number().over(order)}).filter("_at <= _room").select("token", "set_key")


def _forest(part: pa.Table, words: int, percent: int) -> list[tuple[int, int]]:
    """Edges that tie the linked sets of a table (set_key, label, visitor, text).

    Sets with one label count as tied.  If there are visitors, only these scan, and only the lists of the others.
    """
    h, firsts, base = [], [], 0
    for s in slices(text_of(part.column("text"))):
        own, first = shingles(s, words)
        h.append(own)
        firsts.append(first[:-1] + base)
        base += len(own)
    h, first = np.concatenate(h), np.append(np.concatenate(firsts), base)
    keys, labels, visitor = part.column("set_key").to_pylist(), part.column("label").to_pylist(), part.column("visitor").to_numpy()
    n = np.diff(first)
    _, token = np.unique(h, return_inverse=True)
    doc = np.repeat(np.arange(len(n)), n)
    scanning = np.flatnonzero(visitor) if visitor.any() else np.arange(len(n))
    by = np.argsort(token, kind="stable")
    by = by[~visitor[doc[by]]]
    listed = doc[by]
    size = np.bincount(token[by], minlength=int(token.max()) + 1 if len(token) else 0)
    start = np.cumsum(size) - size
    heads: dict[int, int] = {}
    root = [heads.setdefault(label, i) for i, label in enumerate(labels)]
    left = len(heads)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in scanning.tolist():
        if left == 1:
            break
        own = token[first[i] : first[i + 1]]
        lengths = size[own]
        take = np.repeat(start[own], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(listed[take], minlength=len(n))
        for j in np.flatnonzero((shared > 0) & ((100 + percent) * shared >= percent * (n[i] + n))).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                left -= 1
                out.append((keys[i], keys[j]))
    return out


def count_overlaps(words: int, percent: int, most: int):
    """Stars of the links in each task (rows: task, set_key, label, visitor, text, in the order of task); short tasks are run together."""

    def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _forest(pa.Table.from_batches(held), words, percent)
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, joinable = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            task, visitor = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and task[lo] != last and (not joinable or visitor[lo] or sum(x.num_rows for x in held) + hi - lo > most):
                    yield edges(held)
                    held, joinable = [], True
                held.append(batch.slice(lo, hi - lo))
                last, joinable = task[lo], joinable and not visitor[lo:hi].any()
        if held:
            yield edges(held)

    return lambda batches: fold(found(batches))  # in one worker


def _linked(sent: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    width = shuffle_width(sent.sparkSession)
    rows = sent.select("task", "set_key", "label", "visitor", "text").repartition(width, "task").sortWithinPartitions("task", F.desc("visitor"))
    return checkpoint(rows.mapInArrow(count_overlaps(words, percent, block), EDGES))


def visits(many: DataFrame, half: int) -> DataFrame:
    """many (set_key, n, group, label, text) dealt into tasks: the sets outside their group's largest part meet all sets of fitting sizes."""
    parts = many.groupBy("group", "label").agg(F.count(F.lit(1)).alias("sets"))
    main = parts.groupBy("group").agg(F.max_by("label", F.struct("sets", "label")).alias("_main"))
    banded = many.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")).join(main, "group")
    visitors = banded.filter(F.col("label") != F.col("_main")).withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    blocks = lambda df, name: df.groupBy("group", "band").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias(name))
    grid = blocks(banded, "_homes").join(blocks(visitors, "_visits"), ["group", "band"])
    of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "set_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    task = F.xxhash64("group", "band", "home", "visit").alias("task")
    at_home = banded.join(grid, ["group", "band"]).withColumn("home", of("home", "_homes")).withColumn("visit", every("_visits")).withColumn("visitor", F.lit(False))
    away = visitors.join(grid, ["group", "band"]).withColumn("visit", of("visit", "_visits")).withColumn("home", every("_homes")).withColumn("visitor", F.lit(True))
    columns = (task, "set_key", "label", "visitor", "text")
    return at_home.select(*columns).unionByName(away.select(*columns))


def large_links(rows: DataFrame, classes: DataFrame, prefixes: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(a, b) that tie the linked large sets; rows have row_key and text, prefixes are candidate_prefixes()."""
    half = max(1, block // 2)
    least = folded_by(prefixes, "token", _least=F.min("set_key"), _sets=F.count(F.lit(1))).filter("_sets > 1")
    groups = contract(prefixes.join(least, "token").select(F.col("set_key").alias("a"), F.col("_least").alias("b")))
    members = groups.select(F.col("node").alias("set_key"), F.col("component").alias("group"))
    members = members.join(folded_by(members, "group", _all=F.count(F.lit(1))), "group").join(classes.select("set_key", F.col("n_shingles").alias("n"), "rep.row_key"), "set_key")
    sent = checkpoint(members.join(rows.select("row_key", "text"), "row_key").dropDuplicates(["set_key"]).withColumn("label", F.col("set_key")))
    task = lambda of: F.when(F.col("_all") <= half, F.col("group")).otherwise(F.xxhash64("group", F.pmod(F.xxhash64(F.lit("block"), "set_key"), F.ceil(of / half))))
    at_home = _linked(sent.select(task(F.col("_all")).alias("task"), "set_key", "label", F.lit(False).alias("visitor"), "text"), words, percent, half)
    many = sent.filter(F.col("_all") > half)
    if many.isEmpty():
        return at_home
    labelled = lambda df, edges, c="label": df.join(edges.select(F.col(edges.columns[0]).alias(c), F.col(edges.columns[1]).alias("_to")), c, "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")
    many = labelled(many.select("set_key", "n", "group", "label", "text"), at_home)
    heads = many.filter(F.col("set_key") == F.col("label"))
    heads = heads.join(folded_by(heads, "group", _all=F.count(F.lit(1))), "group")
    among = _linked(heads.select(task(F.col("_all")).alias("task"), "set_key", "label", F.lit(False).alias("visitor"), "text"), words, percent, half)
    many = checkpoint(labelled(many, contract(among)))
    return at_home.unionByName(among).unionByName(_linked(visits(many, half), words, percent, block))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id (the smallest id reachable by links) of every row.

    Texts are lower-cased in A-Z.  Null texts and texts without words have no shingle and link with
    nothing.  Repeated rows and copies are one class.  Null ids rank last; a component of rows without ids
    has a null id.  row_key tells rows with other ids or texts apart; first marks one row_key of each
    component, that with the smallest id, and all rows without words.
    """
    width = shuffle_width(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    sets = checkpoint(rows.select("row_key", "doc_id", "text").mapInArrow(describe(words, width), SETS))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    rep = F.min(F.struct(order.alias("doc_order"), "row_key")).alias("rep")
    classes = checkpoint(sets.filter("n_shingles > 0").groupBy("set_key").agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("small").alias("small")))
    boundary = choose_boundary(classes, percent)
    least = -(-percent * (boundary + 1) // 100)
    tokens = rows.select("text").mapInArrow(large_tokens(words, least, percent, KEPT_RANGE, hot_tokens(sets, width)), TOKENS)
    prefixes = checkpoint(candidate_prefixes(tokens, width, percent, KEPT_RANGE))
    links = large_links(rows, classes, prefixes, words, percent, block)
    if boundary:
        links = links.unionByName(small_links(classes, boundary, percent))
    classed = classes.join(contract(links), F.col("set_key") == F.col("node"), "left").select("set_key", F.coalesce("component", "set_key").alias("component"), "rep")
    by_set = classed.join(folded_by(classed, "component", _least=F.min("rep")), "component").select("set_key", "_least")
    found = sets.join(by_set, "set_key", "left")
    some = F.col("n_shingles") > 0
    return found.select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(some, F.nullif("_least.doc_order", F.lit(NO_ID))).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("row_key") == F.col("_least.row_key"))).alias("first"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one with the smallest id.

    Rows with one id and one text count as one row.  Texts without words all stay.
    """
    first = jaccard_components(docs, id_col, text_col, words, percent).filter("first").select("row_key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"))
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
