"""Sharding and mixing: laws, targets, reruns, awkward tables; and the pipeline against plain code."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import mixing, sharding

DATA = "/root/testdata/sf0.001"


def test_hypergeometric_has_its_law():
    rng = random.Random(3)
    for good, bad, take in ((30, 70, 20), (5, 5, 9), (1000, 3000, 500), (0, 4, 2), (3, 0, 3)):
        draws = [sharding.hypergeometric(rng, good, bad, take) for _ in range(4000)]
        assert min(draws) >= max(0, take - bad) and max(draws) <= min(good, take)
        n = good + bad
        mean, var = take * good / n, take * good * bad * (n - take) / (n * n * max(1, n - 1))
        assert abs(np.mean(draws) - mean) <= 5 * (var / 4000) ** 0.5 + 1e-9 and abs(np.var(draws) - var) <= 0.15 * var + 1e-9
    assert 0 < sharding.hypergeometric(rng, 10**10, 2 * 10**10, 10**9) < 10**9


def test_matrix_margins():
    counts = [0, 7, 100, 3, 55]
    m = sharding.communication_matrix(counts, 8, 1)
    assert [sum(r) for r in m] == counts
    sizes = [sum(c) for c in zip(*m)]
    assert sum(sizes) == 165 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [0, 1, 39, 403])
def test_shards(spark, n):
    rows = [(i if i % 7 else None, "copy" if i % 3 else None, i, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _part string")
    out = sharding.uniform_shards(df, 40).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.uniform_shards(df.repartition(3), 40).collect()
    key = lambda r: (r["shard"], r["slot"], r["doc_id"], r["text"])
    assert sorted(map(str, map(key, out))) == sorted(map(str, map(key, again)))


def test_shuffle_is_uniform(spark):
    """Each document is about as often in each shard, over seeds."""
    df = spark.range(60).select(F.col("id").alias("doc_id")).cache()
    seen = np.zeros((60, 4))
    for seed in range(30):
        for r in sharding.uniform_shards(df, 4, seed=seed, partitions=4).collect():
            seen[r["doc_id"], r["shard"]] += 1
    chi = ((seen - 7.5) ** 2 / 7.5).sum()
    assert chi < 180 + 6 * (2 * 180) ** 0.5


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets round by round, as the rule is put."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        add = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, a in add.items():
            target[s] += a
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, _key int")
    return mixing.mix_sources(df, mixing.word_count(F.col("text")))


def test_mix(spark):
    rng = random.Random(5)
    names = ["a", "b", "é", "c", "Z", None]
    rows = [(i, rng.choices(names, [9, 1, 2, 3, 1, 2])[0], " ".join("w" for _ in range(rng.randint(0, 300))), "x", 1) for i in range(500)]
    out = mixed(spark, rows).collect()
    sizes = collections.Counter()
    for _, s, t, *_ in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * mixing.BLOCK_TOKENS
    assert sorted(map(str, out)) == sorted(map(str, mixed(spark, rows[::-1]).collect()))


def test_shards_take_their_quotas(spark):
    """Plain code lays each source's tokens on its line and deals them to the shards block by block."""
    rng = random.Random(8)
    rows = [(i, rng.choice("aab"), " ".join("w" * rng.randint(0, 40)), "x", 1) for i in range(120)] + [(900, "tiny", "w w w", "x", 1)]
    got = mixed(spark, rows).collect()
    targets = spark.createDataFrame([(s, r["source_size"], r["target"]) for s, r in {r["source"]: r for r in got}.items()], "source string, source_size long, target double")
    quotas = {(q["source"], q["shard"]): q["blocks"] for q in mixing.quotas(targets).collect()}
    for source in ("a", "b", "tiny"):
        own = sorted((r for r in got if r["source"] == source), key=lambda r: (r["line_start"], r["line_start"] + r["size"]))
        line = [r["doc_id"] for r in own for _ in range(r["size"])]
        tokens = (line + line)[: sum(quotas[source, k] for k in range(mixing.SHARDS)) * mixing.BLOCK_TOKENS]
        want, at = collections.Counter(), 0
        for shard in range(mixing.SHARDS):
            n = quotas[source, shard] * mixing.BLOCK_TOKENS
            want.update((doc, shard) for doc in tokens[at : at + n])
            at += n
        assert {(r["doc_id"], k): n for r in own for k, n in enumerate(r["shard_taken"]) if n} == dict(want)
        assert all(sum(r["shard_taken"]) == r["taken"] for r in own)
    assert sum(r["taken"] for r in got if r["source"] == "tiny") > 0


def test_quotas_are_highest_quotients(spark):
    targets = spark.createDataFrame([("a", 900, 530.0), ("b", 900, 240.0), ("c", 900, 230.0), ("d", 0, 0.0)], "source string, source_size long, target double")
    got = mixing.quotas(targets, block_tokens=10, n_shards=4).collect()
    seats = sorted(((t / (2 * k + 1), s) for s, t in (("a", 530.0), ("b", 240.0), ("c", 230.0)) for k in range(100)), key=lambda x: (-x[0], x[1]))[:100]
    for shard in range(4):
        want = collections.Counter(s for _, s in seats[25 * shard : 25 * shard + 25])
        assert {r["source"]: r["blocks"] for r in got if r["shard"] == shard} == {s: want[s] for s in "abcd"}


def test_mix_awkward(spark):
    assert mixed(spark, [(None, None, None, None, None), (None, None, None, None, None)]).count() == 2
    one = mixed(spark, [(1, "s", "w " * 50000, None, None)]).first()
    assert one["target"] == 75000 and abs(one["taken"] - 75000) <= mixing.BLOCK_TOKENS
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(df, mixing.word_count(F.col("text"))).count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, size int, key string, taken int, _row int"


def awkward_documents():
    texts = ["der hund und die katze " * 12, "DER hund und die katze " * 12, "", None, "12 34 !", "the dog and the cat sat on the mat by the door " * 8]
    rows = [(i, texts[i % 6] + (f" eins{i} zwei{i}" if i % 12 == 0 else "") if texts[i % 6] is not None else None, ["de", "de", None, "de", None, "en"][i % 6], ["a", None][i % 2], i, None, i, None) for i in range(48)]
    return [*rows, *rows[:6], (None, texts[0], None, None, None, None, None, None)]


@pytest.mark.parametrize("rows", [[], [(None,) * 8] * 3, awkward_documents()])
def test_pipeline_awkward(spark, tmp_path, rows):
    """Empty tables, nulls in every column, repeated rows, texts without words, columns named as the operators name theirs."""
    spark.createDataFrame(rows, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [collections.Counter(map(tuple, docs.collect()))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            kept.append(collections.Counter(map(tuple, out.collect())))
            assert set(kept[-1]) <= set(kept[-2])
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    letters = lambda r: r[1] is not None and any(c.isalpha() for c in r[1])
    assert all(map(letters, kept[1]))
    last = {}  # of equal texts the largest doc_id, none counted as least
    for r in kept[1]:
        low = r[1].encode().lower()
        last[low] = max(last.get(low, -1), -1 if r[0] is None else r[0])
    assert sorted(-1 if r[0] is None else r[0] for r in kept[2].elements()) == sorted(last.values())
    assert sorted(near_copies_out([(r[0], r[1]) for r in kept[2].elements()])) == sorted(r[0] for r in kept[3].elements())
    assert docs.count() == sum(kept[4].values())


def near_copies_out(docs):
    """The smallest id of each group of linked texts, by comparing all pairs."""
    sets = {}
    for i, text in docs:
        words = text.encode().lower().decode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            low = [r[0].encode().lower() for r in docs.select("text").collect()]
            assert len(low) == len(set(low))
    assert seen[1] >= 0.98 * seen[0] and seen[2] <= seen[1] and seen[3] <= seen[2] and seen[4] == seen[5]
    assert corpus_pipeline.run(spark, DATA).count() == seen[5]


@pytest.mark.parametrize("rows_a_task", [1 << 22, 9])
def test_shards_by_plain_code(spark, rows_a_task):
    """The same matrix, the same hashes, dealt and numbered row by row."""
    rows = [(i if i % 3 else None, f"t{i % 50}", i % 7) for i in range(400)] + [(5, "same", 1)] * 12 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    n_shards, seed = 6, 17
    parts = max(8, -(-len(rows) // rows_a_task))
    hashes = [F.xxhash64(F.lit(seed + k), "doc_id", F.struct("doc_id", "text", "k"), *([F.lit("order")] if k else [])).alias(f"h{k}") for k in range(3)]
    known = [(r["h0"] % parts, r["h1"], r["h2"], (r["doc_id"], r["text"], r["k"])) for r in df.select("*", *hashes).collect()]
    last = lambda row: tuple((x is not None, x) for x in row)
    by = collections.defaultdict(list)
    for part, first, second, row in known:
        by[part].append((first, last(row), second, row))
    matrix = sharding.communication_matrix([len(by[p]) for p in sorted(by)], n_shards, seed)
    shards = collections.defaultdict(list)
    for part, counts in zip(sorted(by), matrix, strict=True):
        mine = iter(sorted(by[part]))
        for shard, n in enumerate(counts):
            shards[shard] += [(second, key, row) for _, key, second, row in (next(mine) for _ in range(n))]
    want = sorted(((*row, shard, slot) for shard, got in shards.items() for slot, (_, _, row) in enumerate(sorted(got, key=lambda x: (x[0] % 2**64, x[1])))), key=repr)
    for slices in (2, 16):
        got = sharding.uniform_shards(df, n_shards, partitions=8, slices=slices, rows_a_task=rows_a_task).collect()
        assert sorted(((r["doc_id"], r["text"], r["k"], r["shard"], r["slot"]) for r in got), key=repr) == want


def test_shards_spread_rows_of_one_id(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    parts = df.withColumn("part", F.pmod(F.xxhash64(F.lit(17), "doc_id", F.struct("doc_id", "text")), F.lit(256))).groupBy("part").count()
    assert parts.agg(F.max("count")).first()[0] < 60
    assert sorted(collections.Counter(r["shard"] for r in sharding.uniform_shards(df, 7).collect()).values()) == [571, 571, 571, 571, 572, 572, 572]
