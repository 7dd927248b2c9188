"""Periodic runs, byte-level BPE by ranks and importance resampling against brute force and the ranks' library."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import byte_bpe, periodic, registry, resampling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, uid long, k int, score string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, 1, "s", 7) for i, t in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x).hexdigest()


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    """Every (start, length, period): smallest period by definition, no neighbour extends it."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for x, y, q in runs for i in range(x + q, x + y)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{x},{y},{q}\n" for x, y, q in runs).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))


def scanned(w):
    ids = periodic.ids_of([x.encode() for x in w])
    return [tuple(r) for r in periodic.merged(periodic.scan(ids, periodic.lag_blocks(len(w)))).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_runs_of_made_texts(parts):
    w = [c for text, times in parts for c in text * times]
    assert scanned(w) == brute_runs(w)


def test_runs_of_long_periods():
    rng = random.Random(5)
    for period, times, around in ((1, 500, 3), (37, 4, 90), (37, 9, 0), (64, 5, 31), (100, 6, 50), (129, 4, 0), (6, 40, 1), (12, 33, 2)):
        one = [str(rng.randrange(9)) for _ in range(period)]
        w = [str(rng.randrange(9)) for _ in range(around)] + one * times + one[: period // 3] + [str(rng.randrange(9)) for _ in range(around)]
        assert scanned(w) == brute_runs(w)


def test_runs_do_not_depend_on_lag_ranges():
    rng = random.Random(6)
    w = [x for _ in range(30) for x in [str(rng.randrange(3)) for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 8)]
    ids, n = periodic.ids_of([x.encode() for x in w]), len(w)
    for edges in ([1, 2, 3, 5, 9, 50, n // 4 + 1], [1, 40, n // 4 + 1]):
        found = [periodic.scan(ids, [(max(lo, a), min(hi, b)) for lo, hi in periodic.lag_blocks(n) if lo < b and hi > a]) for a, b in zip(edges, edges[1:], strict=False)]
        assert [tuple(r) for r in periodic.merged(np.concatenate(found)).tolist()] == brute_runs(w)


def test_one_word_a_hundred_thousand_times_takes_no_square():
    n = 100_000
    assert scanned(["x"] * n) == [(0, n, 1)]
    assert scanned(["x", "y", "z"] * n) == [(0, 3 * n, 3)]
    assert scanned([x for i in range(n // 12) for x in [str(i % 5)] * 12])[:2] == [(0, 12, 1), (0, 12 * (n // 12), 60)]


AWKWARD = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x y x y x y x y", "é é é é é é é é", "a b c " * 9 + "d", "ab\x00c " * 8, "w " * 50 + "v " * 50]


def test_periodic_documents(spark):
    rng = random.Random(7)
    texts = [*AWKWARD, *(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 120))) for _ in range(150))]
    rows = [*enumerate(texts, -3), (None, "a b " * 8), (None, "a b " * 8), (4, "a a a a a a a"), (4, "a a a a a a a")]
    want = sorted((brute_document(*r) for r in rows), key=repr)
    for options in ({}, {"long_chars": 30, "lag_ranges": 3}, {"long_chars": 0, "lag_ranges": 2}):
        got = periodic.periodic_runs(table(spark, rows), **options)
        assert got.columns == [c.split()[0] for c in periodic.RESULT.split(", ")]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert periodic.periodic_runs(table(spark, [])).count() == 0


def test_op13_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    want = {r[0]: r for r in (brute_document(*d) for d in docs)}
    got = {r["doc_id"]: tuple(r) for r in registry.op13_periodic_runs(spark, DATA).collect()}
    assert {k: got[k] for k in want} == want and len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()


# ---------------------------------------------------------------- byte-level BPE by ranks


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(byte_bpe.default_ranks()).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


ALPHABET = "ab'stredlvm  \n\t  é日1٣²!.'<|>́😀࢏\U000107bb"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=120) | st.text(max_size=60), st.integers(1, 30), st.integers(0, 12))
def test_chunks_stitch_to_the_librarys_ids(library, text, size, overlap):
    c = byte_bpe.coder(byte_bpe.default_ranks())
    assert c.encode(text, size, overlap) == c.encode(text) == ids_of(library, text)
    assert c.decode(c.encode(text)) == text.encode()


def test_pre_tokens_agree_for_every_character(library):
    c = byte_bpe.coder(byte_bpe.default_ranks())
    every = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x110000))]
    for text in ("".join(every), "".join(f"a{x}" for x in every[:60000]), "".join(f" {x}1" for x in every[:60000])):
        assert c.encode(text) == ids_of(library, text)


def test_a_pre_token_over_many_chunks(library):
    c = byte_bpe.coder(byte_bpe.default_ranks())
    for text in ("x" * 5000, "word " * 50 + "y" * 3000 + " end's" * 100, " " * 4000 + "a", "!" * 999 + "\n" * 1000, "don't " * 800):
        for size, overlap in ((64, 8), (100, 0), (257, 100)):
            assert c.encode(text, size, overlap) == ids_of(library, text)


def test_byte_bpe_documents(spark, library):
    rng = random.Random(8)
    texts = [*AWKWARD, "<|endoftext|> it's", "naïve café — 東京 😀 " * 40, *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(300))) for _ in range(60))]
    rows = [*enumerate(texts), (None, "null id"), (None, "null id"), (3, "again"), (3, "again")]
    want = sorted(((i, len(b := ids_of(library, t or "")) // 4, sha(b), sha((t or "").encode())) for i, t in rows), key=repr)
    for options in ({}, {"long_chars": 40, "chunk_chars": 70}):
        assert sorted(map(tuple, byte_bpe.round_trips(table(spark, rows), **options).collect()), key=repr) == want
        decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(table(spark, rows), **options)).collect()
        assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in decoded), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert byte_bpe.round_trips(table(spark, [])).count() == 0
    assert byte_bpe.decode_documents(spark.createDataFrame([(1, None)], byte_bpe.ENCODED)).collect()[0]["bytes"] == b""


def test_op12_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (len(b := ids_of(library, t or "")) // 4, sha(b), sha((t or "").encode())) for i, t in docs}
    assert {r[0]: tuple(r)[1:] for r in registry.op12_byte_bpe(spark, DATA).collect()} == want


# ---------------------------------------------------------------- importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_resample(docs, target, buckets=10_000, percent=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = (Counter(bucket(w) for text in texts for w in words(text)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, text in docs:
        of = [gain(bucket(w)) for w in words(text)]
        weight = sum(of) // len(of) if of else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    stands = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {}
    for k, r in enumerate(stands[: len(stands) * percent // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in rows), key=repr)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def test_op11_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    got = registry.op11_importance_resampling(spark, DATA)
    assert got.columns == list(COLUMNS) and dict(got.dtypes) == dict.fromkeys(COLUMNS, "bigint")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target)


@pytest.mark.parametrize("most_of_a_score", [1 << 20, 7])
def test_resampling_awkward(spark, most_of_a_score):
    rng = random.Random(9)
    texts = [None, "", "!!!", "only few words", "É é " * 30, "Straße 12 " * 15, *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15, 40))) for _ in range(80))]
    rows = [*enumerate(texts, -5), *((None, "n " * 25) for _ in range(12)), *((7, "a " * 25) for _ in range(40)), *((8, f"{'b ' * 25} c" if k % 2 else "b " * 26) for k in range(20)), (2**63 - 1, "a " * 30), (-(2**63), "a " * 30)]
    target = [None, "a b " * 9, ""]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for percent in (10, 50, 100):
        got = resampling.resample(table(spark, rows), wanted, percent=percent, most_of_a_score=most_of_a_score).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=repr) == brute_resample(rows, target, percent=percent)


def test_a_score_that_many_share_is_numbered_in_stretches(spark):
    """As many rows of one score as that no window may hold them all."""
    rows = [(i, 30, 30, 0, 5) for i in range(5000)] + [(i, 30, 30, 0, 9) for i in range(10)] + [(None, 30, 30, 0, 5)] * 3
    scores = spark.createDataFrame(rows, resampling.SCORED)
    got = resampling.ranked(scores, percent=50, most_of_a_score=100).filter("rank is not null").collect()
    order = sorted(rows, key=lambda r: (-r[4], r[0] is not None, r[0] or 0))[: len(rows) // 2]
    assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(r[0], r[4]) for r in order]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(rows) // 2 + 1))


def test_resampling_without_rows(spark):
    none = table(spark, [])
    assert resampling.resample(none, none).count() == 0
    assert [r["rank"] for r in resampling.resample(table(spark, [(1, "a " * 30), (2, None)]), none).collect()] == [None, None]


def test_more_words_to_a_feature():
    n, buckets = resampling.Features(97, 2).of("A b, c")
    assert (n, buckets) == (3, [zlib.crc32(x) % 97 for x in (b"a", b"b", b"c", b"a b", b"b c")])
