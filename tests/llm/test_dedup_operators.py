"""Exact dedup, substring dedup and the Jaccard join against brute force, and on awkward tables."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import components, exact_dedup, jaccard, substring

SCHEMA = "doc_id long, text string, bucket string, _row_key string, anchor string, token int"


def table(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "b", "r", None, 7) for i, t in rows], SCHEMA)


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(70)]
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    for i in range(60, 110):
        at = rng.randint(0, 40)
        own = [rng.choice(words) for _ in range(60)]
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    for i in range(110, 170):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(base).upper()) for i in range(170, 200)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "ONE"), (205, "two words"), (206, "long " * 30000)]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(3, 11)))) for i in range(207, 400)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def words_of(text):
    return (text or "").encode().split()


def test_exact_dedup(spark, rows):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, rows)).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(body).hexdigest())
    kept = exact_dedup.deduplicate(table(spark, rows))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(max(ids) for ids in groups.values())


def test_exact_dedup_spills(monkeypatch):
    """Buckets far over the table's memory split into files and still give one group for each text."""
    records = [(random.Random(t).getrandbits(63), b"", f"text {t}".encode(), [n * 1000 + t], None) for n in range(5) for t in range(300)]
    found = collections.defaultdict(list)
    tables = set()
    for t, members in exact_dedup.grace(iter(records), limit=4000):
        tables.add(id(t))
        for i, ids in members:
            found[t.bodies[i]] += ids
            assert t.count[i] == 5
    assert len(tables) > 8 and len(found) == 300 and all(sorted(x) == [n * 1000 + int(b.split()[1]) for n in range(5)] for b, x in found.items())


def test_exact_dedup_ties_and_nulls(spark):
    got = exact_dedup.exact_dedup(table(spark, [(1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b")])).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 5
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {1} and {r["keep_id"] for r in got if r["group_size"] == 2} == {None}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0 and exact_dedup.deduplicate(table(spark, [])).count() == 0


def brute_removed(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(spark, rows):
    rows = [(i, t) for i, t in rows if i != 206] + [(206, "long " * 300), (500, "long " * 200)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(table(spark, rows)).collect()}
    assert got == brute_removed(rows)


def test_substring_awkward(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.remove_repeats(table(spark, [(None, text), (3, text), (3, text), (5, None), (1, "x " + text)])).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got) == [(1, 0), (3, 60), (3, 60), (5, 0), (99, 60)]
    assert substring.remove_repeats(table(spark, [])).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        for j, o in collections.Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [400, 8])
def test_jaccard_components(spark, rows, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows), block=block).collect()}
    assert got == brute_components(rows)


def test_jaccard_keeps_one_of_each(spark, rows):
    want = brute_components(rows)
    kept = sorted(r[0] for r in jaccard.one_of_each(table(spark, rows)).select("doc_id").collect())
    assert kept == sorted(i for i, (n, c) in want.items() if i == c)


def test_jaccard_awkward(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = jaccard.jaccard_components(table(spark, [(None, text), (None, text + " x"), (4, text), (9, None), (9, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 4), (0, 4), (4, 4), (8, 8), (9, 9), (9, 9)]
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def overlapping(n, seed=9):
    """Texts of four passages in a row, each beginning a passage after the one before: candidates of their neighbours, but no links."""
    rng = random.Random(seed)
    passages = [" ".join(f"v{rng.randrange(100000)}" for _ in range(10)) for _ in range(n + 3)]
    return [(i, " ".join(passages[i : i + 4])) for i in range(n)]


def test_jaccard_of_a_large_group_without_links(spark):
    """A group of many blocks whose members are candidates and do not link, beside some that do."""
    rows = overlapping(300)
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows), block=8).collect()}
    assert got == brute_components(rows) and got[1005][1] == 5


def test_needed_overlap_is_the_threshold():
    for a in range(1, 40):
        for b in jaccard.partners(a):
            c = jaccard.needed(a, b)
            assert 100 * c >= 75 * (a + b - c) and 100 * (c - 1) < 75 * (a + b - c + 1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
