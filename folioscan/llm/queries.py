"""The registered queries of the training-data operators, one for each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, fingerprints, jaccard, line_dedup, lm_scoring, mixing, packing, pii, runs, suffix_dedup, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: A repeated passage has over 50 words.
PASSAGE_WORDS = 51


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "rejected",
    )


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.withColumn("base", F.filter("pii", lambda s: s["kind"].isin(*pii.BASE)))
    return base.select(
        "doc_id",
        *[_count("base", kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score_by_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "target_loss", "background_loss", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints.with_next(docs, ["text", "own"], lambda rows: fingerprints.add_fingerprint(rows, "text", "own"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    docs = fingerprints.add_fingerprint(docs, "edited", "edited_own")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_string("own").alias("fingerprint"),
        fingerprints.as_string("edited_own").alias("edited_fingerprint"),
        fingerprints.likeness("own", "edited_own").alias("near_edited"),
        fingerprints.likeness("own", "next_own").alias("near_next"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"), words=PASSAGE_WORDS)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_sha256().alias("centroid_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents of the contract: in some of them the words from one on repeat a period."""
    h, word = F.crc32(F.col("doc_id").cast("string").cast("binary")), r"[^\x20\x09-\x0D]+"
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(word), F.lit(0)))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), rest)), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("collapsed"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")), "collapsed")
    best = F.col("best")
    return found.withColumn("best", runs.longest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(runs.runs_text("runs"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path(TOKENIZER))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Spark query by name.
QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit_packing": op13_best_fit_packing,
    "pipeline": pipeline,
}



def _lloyd_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one pair of common table expressions each. ``c0`` are the first centroids."""
    gap = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = f"select *, {gap}::bigint as d from v, c%d"
    steps = [
        f"""a{r} as materialized (select i, v, arg_min(k, (d, k)) as k from ({nearest % r}) group by i, v),
            s{r} as (select k, j, sum(v[j])::bigint as s, count(*) as n from a{r}, range(1, 65) t(j) group by k, j),
            m{r} as (select k, list((s - ((s % n) + n) % n) // n order by j) as c from s{r} group by k),
            c{r + 1} as materialized (select k, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (k))"""
        for r in range(rounds)
    ]
    return rf"""
        with v as materialized (
               select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
               where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
             c0 as materialized (
               select row_number() over (order by h, v) - 1 as k, v as c
               from (select sha256('2:' || coalesce(vec_id::varchar, '')) as h, v from v order by h, v limit {clusters})),
             {", ".join(steps)},
             f as materialized (select vec_id, i, arg_min(k, (d, k)) as k, min(d) as d, arg_min(c, (d, k)) as c from ({nearest % rounds}) group by vec_id, i)
        select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
               (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from f"""


#: DuckDB SQL for the same rows, where SQL can say it.
ORACLES = {
    "op5_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
             g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256
        from n join g using (t)""",
    "op6_mixing": r"""
        with d as (select doc_id, source, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as place,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
             s as (select source, sum(size)::bigint as source_size from d group by source),
             w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight,
                          source_size * 3 as most, sum(source_size) over () as budget from s),
             o as (select *, budget - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as remains,
                          sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as shares from w),
             p as (select *, most * shares < remains * weight as stops from o),
             q as (select source, source_size, budget, weight, most, stops,
                          budget - sum(case when stops then most else 0 end) over () as remains,
                          sum(case when stops then 0 else weight end) over () as shares from p),
             t as (select source, source_size, budget,
                          case when stops then most::double else (weight * remains)::double / shares::double end as target from q),
             e as (select d.*, t.source_size, t.target, t.budget,
                          sum(size) over (partition by d.source order by place, doc_id, size rows between unbounded preceding and current row) as upto
                   from d join t on d.source is not distinct from t.source),
             c as (select doc_id, size, place, budget, pass, (pass * source_size + upto)::double / target as finish
                   from e, range(3) r(pass) where size > 0 and pass * source_size + upto - size < target),
             f as (select *, sum(size) over (order by finish, place, pass rows between unbounded preceding and current row) as total from c),
             k as (select doc_id, sum(least(size, budget - (total - size)))::bigint as taken from f where total - size < budget group by doc_id)
        select e.doc_id, e.size, e.source_size, e.target, coalesce(k.taken, 0)::bigint as taken
        from e left join k on e.doc_id is not distinct from k.doc_id""",
    "op9_line_dedup": r"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
             l as (select doc_id, n, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
                   from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from d)),
             g as (select key, max(doc_id) as keeper from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
             m as (select l.*, g.key is not null and l.doc_id <> g.keeper as lost from l left join g using (key))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by n) filter (not lost), '')) as kept_sha256
        from m group by doc_id""",
    "op11_centroid_clustering": _lloyd_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
