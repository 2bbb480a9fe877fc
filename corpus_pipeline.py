"""From documents to tokens: toxicity, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from folioscan.llm.common import col, fresh, materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts at the threshold of their language. Null and empty texts are scored as texts
    without words, a null language has the common threshold, rows that repeat are judged alike; without labels of both
    kinds nothing goes. An empty table stays empty, columns may have any names."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if model.constant is not None:
        return docs
    clashing = [c for c in docs.columns if c.lower() in ("score", "rejected")]
    held = dict(zip(clashing, fresh([*docs.columns, "score", "rejected"], *clashing), strict=True))
    scored = toxicity.classify(docs.withColumnsRenamed(held), model)
    return scored.filter(~F.col("rejected")).select(*[col(held.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for runs of white space the one with the smallest doc_id; null and empty texts are
    equal, a null doc_id stays only where all of its group are null. Other columns decide nothing."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by five-word shingles at 0.75 or more, the smallest doc_id (null first).
    Texts without words stay; rows that share an id are judged by their own texts."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources with weights 5, 2, 1: one row for each copy that it takes of a document. Null sources are one
    source, the last; texts without words are never taken."""
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of the whole text (packed little-endian unsigned 32-bit integers). A null text
    has no ids; rows are independent."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]

#: The classifier and the tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}-{name.replace(' ', '-')}")
    return docs
