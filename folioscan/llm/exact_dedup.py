"""Exact duplicates through an extendible-hash index on shared files. DataFrame operations only.

1. Every row has a 64-bit key, the hash of its normalised text.
2. A directory over the top bits of the keys starts with as many slots as the keys need at least and is doubled until no
   bucket is overfull; a bucket that needed no split keeps its smaller depth and several slots.
3. Texts whose key several rows have are dealt to the buckets that the directory names. Copies are combined where they
   are, in PARTS parts of a text, so that many copies are few rows. The task that owns a bucket goes through its keys in
   order, compares the bytes of neighbours, and chains the texts of a key that differ. It writes them as its bucket.
4. Rows look their bucket up in the directory, their key up in the bucket, and find themselves in its chain. A key
   without a chain is that of one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, col, fresh, materialize, sized_broadcast, skew_safe_left_join

#: Distinct keys in a bucket before it splits.
BUCKET_KEYS = 5_000
#: Rows of one text that reach the owner of its bucket at most.
PARTS = 64


def normalised(text: str = "text") -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), f"[{WS}]+", " ")


def hash_key(norm: str = "norm") -> Column:
    return F.xxhash64(norm)


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(groups: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(slot, depth, bucket) of the directory over the distinct keys in ``groups``, and its depth, that is how many top
    bits of a key are its slot. A bucket is named after its first slot; its depth says how many bits its slots share.
    """
    keys = groups.count()
    depth = max(0, math.ceil(math.log2(max(1, keys) / bucket_keys)))
    while True:
        filled = groups.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("keys"))
        if depth == 63 or (filled.agg(F.max("keys")).first()[0] or 0) <= bucket_keys:
            break
        depth += 1  # a bucket is overfull: the directory doubles
    slots = groups.sparkSession.range(1 << depth).select(F.col("id").alias("slot")).join(sized_broadcast(filled, 1 << depth), "slot", "left").na.fill(0, ["keys"])
    # The keys under each node of the tree of slots that a slot falls under, for all depths.
    nodes = slots.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    nodes = nodes.withColumn("node", F.expr(f"shiftright(slot, {depth} - depth)"))
    sums = nodes.groupBy("depth", "node").agg(F.sum("keys").alias("under"))
    fits = nodes.join(sized_broadcast(sums, 2 << depth), ["depth", "node"]).filter((F.col("under") <= bucket_keys) | (F.col("depth") == depth))
    found = fits.groupBy("slot").agg(F.min("depth").alias("depth"))
    return found.select("slot", "depth", F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)").alias("bucket")), depth


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after ``normalised``; a null text equals an empty one. The row with the
    smallest doc_id of a group stays; a null doc_id stays only where its whole group has none (keep_id is then
    null). Rows that repeat both doc_id and text are one document: they share ``kept`` and each counts in
    group_size. An empty table gives an empty result; other columns are not read.
    """
    norm = docs.select(col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("norm")).withColumn("key", hash_key())
    entries = materialize(norm.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-entries")
    groups = materialize(entries.groupBy("key").agg(F.count("*").alias("rows")), "dedup-keys")
    slots, depth = directory(groups, bucket_keys)
    slots = sized_broadcast(materialize(slots, "dedup-directory"), 1 << depth)
    to_bucket = lambda rows: rows.withColumn("slot", _slot(depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")
    several = sized_broadcast(groups.filter("rows > 1").select("key"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    dealt = to_bucket(norm.join(several, "key", "left_semi")).groupBy("bucket", "key", "norm", part)
    dealt = dealt.agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # The owner's walk: neighbours with the same bytes have the same place in the chain.
    owned = dealt.repartition("bucket")
    order = Window.partitionBy("bucket", "key").orderBy("norm")
    other = F.lag("norm").over(order).isNull() | (F.lag("norm").over(order) != F.col("norm"))
    placed = owned.withColumn("other", other.cast("int")).withColumn("place", F.sum("other").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = placed.groupBy("bucket", "key", "place").agg(F.first("norm").alias("norm"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    buckets = materialize(texts.sortWithinPartitions("bucket", "key", "place"), "dedup-buckets")
    chain = F.collect_list(F.struct(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")).alias("chain")  # different texts with one 64-bit key
    index = materialize(buckets.groupBy("bucket", "key").agg(F.sum("group_size").alias("rows"), chain), "dedup-index")
    found = skew_safe_left_join(materialize(to_bucket(entries), "dedup-dealt"), index, ["bucket", "key"], "rows")
    found = found.withColumn("own", F.get(F.filter("chain", lambda x: x["sha"] == F.col("sha")), F.lit(0)))
    keep = F.when(F.col("own").isNotNull(), F.col("own.keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("own.group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat doc_id and text, one stays (see
    ``exact_duplicates`` for nulls, empty texts and ties). Columns may have any names."""
    id_, sha, own = fresh(docs.columns, "__id", "__sha", "__s")
    dropped = exact_duplicates(docs, doc_id, text, bucket_keys).select("doc_id", "text_sha256", "kept", "group_size")
    dropped = materialize(dropped.filter("group_size > 1"), "dedup-dropped")
    gone = dropped.filter("not kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(own, F.sha2(normalised(text), 256))
    rest = marked.join(sized_broadcast(gone), col(doc_id).cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_anti")
    again = dropped.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count()
    if again:  # rows that repeat an id and a text
        rest = rest.dropDuplicates([doc_id, own])
    return rest.drop(own)
