"""Searches by bounds of blocks, of one query and of many, and lookups that read little."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators.search import matching, parse_query, ranked
from folioscan.plans import blocks as K
from folioscan.plans import postings as P
from folioscan.sources import tables

VOCABULARY = [a + b + c for a in ("ma", "me", "lo") for b in ("ri", "ro", "zo") for c in ("", "t", "tta", "ttins")]
QUERIES = ["mari", "marit lozo", "mero meri lorit", "zzz", "zzz mari", "m", "marit marits", ""]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    files = [(i, f"{rng.choice(VOCABULARY)}_{i}.txt", "ok" if i % 4 else "name_only") for i in range(400)]
    texts = [(i, " ".join(rng.choices(VOCABULARY, weights=[1 / (k + 1) for k in range(len(VOCABULARY))], k=rng.randint(1, 60)))) for i, _, s in files if s == "ok"]
    f, t = spark.createDataFrame(files, "id long, name string, status string"), spark.createDataFrame(texts, "file_id long, body string")
    posted = tables.written(P.postings(f, t, "light"), "test-postings")
    return f, posted, tables.written(P.lengths(f, posted), "test-lengths"), K.indexed(f, t, "light", 16)


def expected(corpus, text, mode, limit):
    files, posted, lengths, _ = corpus
    q = parse_query(text, "light")
    if not q.terms:
        return [], True
    found, every = matching(posted, lengths, q, mode)
    return [(r["rank"], r.file_id, r.n_terms, round(r.score, 9)) for r in ranked(found, files, limit).collect()], every


def rows(df):
    return sorted((r["rank"], r.file_id, r.n_terms, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("text", "mode", "limit"), [(q, "fallback", 7) for q in QUERIES if q != "zzz"] + [("marit lozo", "or", 3), ("marit lozo", "and", 100), ("mari", "or", 500)])
def test_best_files_are_the_ranked_ones(corpus, text, mode, limit):
    blocked, blocks, totals = corpus[3]
    q = parse_query(text, "light")
    got, every = K.best_files(blocked, blocks, q.terms, q.stems, totals, limit, mode)
    want, whole = expected(corpus, text, mode, limit)
    assert rows(got) == want and (every == whole or not want)


def test_blocks_below_the_last_hit_are_not_scored(corpus):
    blocked, blocks, totals = corpus[3]
    query = K.OneQuery(blocked, blocks, P.phrases(("lorottins",), ("lorottin",)), totals)
    top, scored = query.best(5, True)
    every = query.bounds(True).count()
    assert len(top) == 5 and scored < every / 2 and every > 20


def test_many_queries_are_as_one_by_one(spark, corpus):
    blocked, _, totals = corpus[3]
    asked = [*enumerate(QUERIES), (98, None), (None, "mari"), (1, "marit lozo")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for mode, limit in (("fallback", 7), ("or", 4), ("and", 1000)):
        got = {}
        for r in K.best_files_of_many(blocked, queries, totals, limit, mode, "light").collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.file_id, r.n_terms, round(r.score, 9), r.every_word))
        for i, text in enumerate(QUERIES):
            want, every = expected(corpus, text, mode, limit)
            copies = 2 if i == 1 else 1  # an id that repeats
            assert sorted(got.pop(i, [])) == sorted([(*w, every) for w in want] * copies), (mode, text)
        assert set(got) <= {None}
    assert K.best_files_of_many(blocked, queries.limit(0), totals, 5).count() == 0


def test_many_queries_meet_files_in_shards(spark, corpus, monkeypatch):
    """Queries times blocks are no rows of a table: cells of a shard and a chunk are added up in one task each."""
    blocked, _, totals = corpus[3]
    monkeypatch.setattr(K, "SHARD_FILES", 60)
    monkeypatch.setattr(K, "CHUNK_QUERIES", 3)
    texts = ["mari", "marit lozo", "mero meri lorit", "zzz mari", "marit marits", "lozottins meritta"]
    queries, names = spark.createDataFrame([*enumerate(texts)], "query_id long, text string"), []
    written = K.written
    monkeypatch.setattr(K, "written", lambda df, name: names.append((name, written(df, name))) or names[-1][1])
    found = K.best_files_of_many(blocked, queries, totals, 7, "fallback", "light")
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.file_id, r.n_terms, round(r.score, 9), r.every_word))
    for i, text in enumerate(texts):
        want, every = expected(corpus, text, "fallback", 7)
        assert sorted(got[i]) == sorted((*w, every) for w in want)
    assert dict(names)["search-found"].count() <= totals[0]  # one row a file
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_prefixes_meet_tokens_by_equality(spark):
    tokens = spark.createDataFrame([("stems", t) for t in ("a", "ab", "abcdefghij", "abcdefgh", "abcdefghxx", "été", "")], "col string, token string")
    prefixes = spark.createDataFrame([("stems", p) for p in ("a", "abcdefgh", "abcdefghi", "é", "b", "")] + [("name", "a")], "col string, prefix string")
    met = K.prefix_matches(prefixes, tokens)
    want = {(p, t) for _, p in prefixes.collect() for _, t in tokens.collect() if _ == "stems" and p and t.startswith(p)}
    assert {(r.prefix, r.token) for r in met.filter("col = 'stems'").collect()} == want and met.filter("col = 'name'").count() == 0
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def rows_read(df):
    """Rows that the scan of a collected plan passed on, after row groups and pages were skipped."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    n, path = 40_000, str(tmp_path / "texts")
    source = spark.range(n).select((F.col("id") * 7919 % n).alias("file_id"), F.sha2(F.col("id").cast("string"), 512).alias("body"), F.sha2(F.col("id").cast("string"), 256).alias("path"))
    tables.write_keyed(source, path, "file_id", ["path"], row_group=128 << 10)
    texts, ids = spark.read.parquet(path), [3, 17_000, 17_001, *range(25_000, 25_012), 39_999]
    found = tables.lookup(texts, "file_id", ids)
    assert sorted(r.file_id for r in found.collect()) == ids and rows_read(found) < n / 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(file_id, [17000," in plan and "In(file_id, [25007," in plan.split("PushedFilters")[1]
    known = texts.first().path
    one = texts.filter(F.col("path") == known)
    assert one.count() == 1 and len(one.collect()) == 1 and rows_read(one) < n / 4  # by the Bloom filter: paths have no order
    assert tables.lookup(texts, "file_id", []).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
