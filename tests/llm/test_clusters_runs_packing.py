"""Centroid clustering, periodic runs and packing against brute force, on awkward tables, and with one hot key."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import centroids, packing, runs
from folioscan.llm import queries as Q

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(Q.TOKENIZER)
TEXTS = [
    (1, None), (2, ""), (3, "one two  three\nfour five six seven " * 3), (4, "a b c " * 8), (4, "a b c " * 8), (5, " x" * 9000 + "y" * 30_000),
    (6, "<|endoftext|> a<|endoftext|>"), (7, "  two spaces   and\ttabs   here \x1c\x85 end "), (8, "\n"), (9, " "), (10, "ab" * 20_000),
    (11, "it's  we'll 12 345, 名前は 何 é́ !"), (None, "no id"), (None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 7, 8, 9) for i, t in TEXTS], "doc_id long, text string, length int, `Ids` int, `a.b` int")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# Centroid clustering


def lloyd(rows, clusters, rounds, dims, scale=256):
    """Plain Python, in the order of the definition."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, v in sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), k) for k, c in enumerate(now))
    for _ in range(rounds):
        held = [near(v)[1] for _, v in kept]
        now = [[sum(x) // held.count(k) for x in zip(*[v for (_, v), h in zip(kept, held, strict=True) if h == k], strict=True)] if k in held else c for k, c in enumerate(now)]
    return sorted(((i, *near(v)[::-1], now[near(v)[1]]) for i, v in kept), key=str)


def test_clusters_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{DATA}/embeddings.parquet'")
    name = "op11_centroid_clustering"
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.sql(Q.ORACLES[name]).df()
    got, want = (x[sorted(x.columns)].sort_values("vec_id").reset_index(drop=True) for x in (got, want))
    assert len(got) == 500 and list(got.columns) == list(want.columns) and (got == want).all().all()


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_clusters(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 3)))]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(300, 400)]  # one vector that a third of the rows have
    rows += [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [0.0, float("-inf"), 0.0]), (7, [0.1] * 4), (None, [9.0, 9.0, 9.0]), (0, [-1.0, 0.0, 1.0]), (0, [-1.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(5)
    out = centroids.cluster(df, 7, rounds, dims=3).collect()
    got = [(r.vec_id, r.cluster, r.distance, r.centroid) for r in out]
    want = lloyd(rows, 7, rounds, 3)
    assert sorted(got, key=str) == want
    assert {r.inertia for r in out} == {sum(w[2] for w in want)}
    assert {(r.cluster, r.cluster_inertia) for r in out} == {(k, sum(w[2] for w in want if w[1] == k)) for k in {w[1] for w in want}}


def test_clusters_of_few_and_far_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], schema), dims=2).count() == 0
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3.0]), (3, [1e7, 1.0])]
    got = [(r.vec_id, r.cluster, r.distance, r.centroid) for r in centroids.cluster(spark.createDataFrame(rows, schema), 2, 2, dims=2).collect()]
    assert sorted(got, key=str) == lloyd(rows, 2, 2, 2)  # beyond what 64 bits of a plain difference hold
    far = centroids.cluster(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0])], schema), 1, 1, dims=2).collect()
    assert {r.distance for r in far} <= {2**63 - 1, 2**100} and len(far) == 2


# Periodic runs


def brute_runs(words, least=12):
    """By definition: for each period, the longest stretches in which it holds; the smallest period of a stretch counts."""
    found, codes = {}, np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    for p in range(1, len(words) // 2 + 1):
        same = np.concatenate([[False], codes[:-p] == codes[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= p and b - a + p >= least:
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), min_size=1, max_size=4), st.sampled_from([2, 12]))
def test_runs(texts, least):
    got = runs.runs_of_texts(texts, least)
    assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(t, least) for t in texts]
    assert [runs.collapsed_words(t, g) for t, g in zip(texts, got, strict=True)] == [collapsed(t, brute_runs(t, least)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 30), st.integers(0, 200), st.integers(0, 2**32))
def test_long_periods(period, lead, size, seed):
    rng = np.random.default_rng(seed)
    unit = [b"%d" % x for x in rng.integers(0, 50, period)]
    text = [b"%d" % x for x in rng.integers(0, 50, lead)] + [unit[i % period] for i in range(size)] + [b"%d" % x for x in rng.integers(0, 50, lead)]
    assert list(map(tuple, runs.runs_of_texts([text])[0].tolist())) == brute_runs(text)


def test_runs_of_small_blocks(monkeypatch):
    texts = [[b"%d" % (i % 7) for i in range(200)], [b"x"] * 90, []]
    want = [list(map(tuple, r.tolist())) for r in runs.runs_of_texts(texts)]
    monkeypatch.setattr(runs, "PAIRS", 5)
    assert [list(map(tuple, r.tolist())) for r in runs.runs_of_texts(texts)] == want == [brute_runs(t) for t in texts]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in Q.op12_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 5
    for i, text in rows:
        words = planted(i, text)
        found, r = brute_runs(words), got[i]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.n_runs == len(found) and r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in found))
        assert r.collapsed_sha256 == sha(collapsed(words, found))


def test_runs_awkward(spark, awkward, empty):
    out = runs.find_runs(awkward).collect()
    assert len(out) == len(TEXTS) and set(runs.find_runs(awkward).columns) == {*awkward.columns, "n_words", "runs", "collapsed"}
    for r, (i, t) in zip(out, TEXTS, strict=True):
        words = (t or "").encode().split()
        want = brute_runs(words)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (i, len(words), want, collapsed(words, want).decode())
    assert runs.find_runs(empty).count() == 0
    assert runs.find_runs(awkward.withColumnRenamed("text", "Collapsed"), "Collapsed").where("doc_id = 3").first().n_words == 21


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(TOKENIZER)
    out.encode_special_tokens = True
    return out


def cut(ids, size=2048):
    first = (len(ids) - 1) % size + 1
    ends = list(range(first, len(ids) + 1, size))
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def one_by_one(sizes, size):
    """Best-two-fit, one sequence at a time, looking at all pairs."""
    left, out = Counter(sizes), 0
    while left:
        bin_, gap = [], size
        while fits := [n for n in left if n <= gap and left[n] > bin_.count(n)]:
            bin_.append(max(fits))
            gap -= max(fits)
        least = min(bin_)
        spare = sorted(n for n in left if left[n] > bin_.count(n))
        pairs = [(a + b, b, a) for i, a in enumerate(spare) for b in spare[i:] if a + b <= gap + least and (a != b or left[a] - bin_.count(a) > 1)]
        if gap and pairs and max(pairs)[0] > least:
            bin_.remove(least)
            bin_ += max(pairs)[1:]
        left -= Counter(bin_)
        out += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.sampled_from([30, 37, 64]))
def test_plan_equals_packing_one_by_one(sizes, size):
    plan = packing.best_two_fit(dict(Counter(sizes)), size)
    assert all(sum(lengths) <= size and many > 0 for lengths, many in plan)
    assert Counter([n for lengths, many in plan for _ in range(many) for n in lengths]) == Counter(sizes)
    assert sum(many for _, many in plan) == one_by_one(sizes, size)


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = dict(Counter(np.minimum(rng.lognormal(5.5, 1.2, 300_000).astype(int) + 1, 2048).tolist()))
    small, large = (packing.best_two_fit({n: c * k for n, c in counts.items()}, 2048) for k in (1, 10_000))
    assert len(list(packing.slots(large))) < 2 * len(list(packing.slots(small))) < 200_000
    whole = sum(n * c for n, c in counts.items())
    assert sum(many for _, many in small) <= 1.001 * whole / 2048 + 1


def valid(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark, tokenizer):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    got = Q.op13_best_fit_packing(spark, DATA).collect()
    want = []
    for i, text in rows:
        at = 0
        for number, ids in enumerate(cut([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])):
            want.append((i, number, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = valid(got)
    assert n == one_by_one([w[3] for w in want], 2048) and n <= 1.01 * sum(w[3] for w in want) / 2048 + 1


def test_packing_awkward(spark, awkward, empty, tokenizer):
    pieces = packing.token_pieces(awkward, TOKENIZER, size=100)
    assert pieces.columns == ["doc_id", "a.b", "piece", "start", "length", "ids"]
    rows = pieces.collect()
    want = Counter()
    for i, t in TEXTS:
        for number, ids in enumerate(cut([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 100)):
            want[i, number, np.array(ids, "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in rows) == want
    packed = packing.pack(pieces.withColumn("OFFSET", F.lit("x")), 100)
    assert valid(packed.collect(), 100) == one_by_one([len(x[2]) // 4 for x in want.elements()], 100)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    none = packing.token_pieces(empty, TOKENIZER)
    assert none.count() == 0 and packing.pack(none).count() == 0 and packing.sequences(packing.pack(none)).count() == 0
    with pytest.raises(ValueError, match="no length"):
        packing.pack(spark.createDataFrame([(5,), (None,)], "length int"))


def test_ids_are_made_without_their_places(tokenizer):
    """The library's call that keeps the place of each id takes about 1.7 times as long; its ids are the same."""
    path, whole = public_tokenizers.path(Q.TOKENIZER), Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    with open(path, encoding="utf-8") as f:
        coder = packing.Tokens(f.read())

    class Fast:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def encode_batch_fast(self, *args, **named):
            self.calls += 1
            return self.inner.encode_batch_fast(*args, **named)

    coder.tokenizer = fast = Fast(coder.tokenizer)  # it has no other call
    texts = ["", " ", "a", "one two  three\n four", "don't  stop é中😀 \t x", "<|endoftext|> a1b2 " * 50, "x" * 3000]
    whole.encode_special_tokens = True
    assert coder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert fast.calls


def test_a_word_is_encoded_once_whatever_ends_or_precedes_it(tokenizer):
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = packing.Tokens(f.read())
    seen, ids = [], coder._ids
    coder._ids = lambda text: seen.append(text) or ids(text)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    texts = [" ".join(["x", *(w + mark for w in words)]) for mark in ("", ",", ".", "!!", ").", "'")] + ["\n".join(w + mark for w in words) for mark in ("", ".", ";")]
    assert coder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(map(len, seen)) < 2.5 * sum(len(w) + 1 for w in words)  # once after a space and once after a line break


def test_ids_around_white_space_and_punctuation(tokenizer):
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = packing.Tokens(f.read())
    parts = ["", "a", "é.", "1,", "'s", "don't", "##", "中!", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c"]
    texts = ["".join(x) for n in range(4) for x in itertools.product(parts, repeat=n)]
    assert coder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_remembered_words(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE", 5)
    with open(TOKENIZER, encoding="utf-8") as f:
        coder = packing.Tokens(f.read())
    for text in ("one two three four", "five six seven eight one two", "x  y z " + "q" * 99 + " two"):
        assert coder.encode([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(coder.known) <= 5


def test_hot_length_is_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 100)
    rows = spark.range(6000).select("id", F.when(F.col("id") < 5000, 7).otherwise(F.col("id") % 50 + 1).alias("length"))
    out = packing.pack(rows, 64).collect()
    assert valid(out, 64) and {r.id for r in out} == set(range(6000)) and len(out) == 6000
