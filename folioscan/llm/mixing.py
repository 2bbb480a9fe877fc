"""Mixing sources to target weights by weighted fair queueing.

Each document gets a virtual finish time: the tokens of its source up to its end, in a shuffled order, divided by the
source's target weight. Sorting all documents by it interleaves the sources in proportion to their weights; the mix
is cut where its tokens reach the total budget. Sources that are too small for their weight are read again, up to
``max_passes`` times. Prefix sums run in two steps, over ranges and within a range, so no source and no sort is one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WS, col, fresh, materialize, sized_broadcast

#: Ranges of the shuffled order in each source, and of the virtual time.
RANGES = 4096


def word_count(text: str = "text") -> Column:
    """Number of runs of characters that are not white space (null: 0)."""
    gaps = F.regexp_replace(F.coalesce(col(text), F.lit("")), f"[^{WS}]+", "\x01")
    return (F.length(F.regexp_replace(gaps, f"[{WS}]+", ""))).cast("long")


def place(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Where a row stands in the shuffled order, 32 hexadecimal digits: by its id and its text, so that rows that share an
    id, or have none, are spread like others."""
    own = F.md5(F.coalesce(col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(col(doc_id).cast("string"), F.lit("")), own).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_passes: int) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has one row a source (source, source_size).

    Weights go to the sources by code point, null last, and repeat. Targets share ``share`` of all sizes by weight;
    those above ``max_passes`` times their source stop there and the others share what is left: the sources that
    stop are those with the smallest size for their weight, so one pass in that order finds them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_passes)
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        ranked.withColumn("budget", F.floor(F.sum("source_size").over(whole) * F.lit(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("most") * F.col("shares") < F.col("left") * F.col("weight"))
    )
    final = (
        stepped.withColumn("left", F.col("budget") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(whole))
        .withColumn("shares", F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(whole))
    )
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("shares"))
    return final.select("source", "source_size", target.alias("target"), "budget")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    max_passes: int = 3,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, content (hash of the text).

    size: words of the text (null or empty: 0). taken: words that the mix takes of the row, repeats counted; the copy
    at which the budget ends counts in part. copies: how often the row is taken, in part or whole. Null sources are
    one source, the last. Repeated rows are rows of their own; those with one id go by size and the hash of the text, and
    only rows that are equal in all that may swap. An empty table gives an empty result. The order depends on the rows
    and ``seed`` only, so reruns agree.
    """
    content = F.xxhash64(F.coalesce(col(text), F.lit("")))
    base = docs.select(col(doc_id).cast("long").alias("doc_id"), col(source).cast("string").alias("source"), word_count(text).alias("size"), content.alias("content"), place(seed, doc_id, text).alias("place"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    base = materialize(base.withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")), "mix-sizes")
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    plan = materialize(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_passes), "mix-targets")
    key = lambda d: d.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).drop("source")
    placed = (
        base.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
        .join(key(ranges), ["_s", "_n", "range"])
        .join(sized_broadcast(key(plan)), ["_s", "_n"])
    )
    inside = Window.partitionBy("_s", "_n", "range").orderBy("place", "doc_id", "size", "content", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.col("ahead") + F.sum("size").over(inside))
    copies = (
        placed.filter("size > 0 and target > 0")
        .select("row", "size", "place", "source_size", "target", "budget", "end", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass"))
        .withColumn("start", F.col("pass") * F.col("source_size") + F.col("end") - F.col("size"))
        .filter(F.col("start") < F.col("target"))
        .withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
        .withColumn("time", F.least(F.floor(F.col("finish") * (RANGES - 64)), F.lit(RANGES)).cast("int"))
        .select("row", "size", "place", "pass", "finish", "time", "budget")
    )
    copies = materialize(copies, "mix-copies")
    times = copies.groupBy("time").agg(F.sum("size").alias("words"))
    earlier = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    times = F.broadcast(times.select("time", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier")))  # RANGES rows at most
    upto = Window.partitionBy("time").orderBy("finish", "place", "pass", "row").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        copies.withColumn("upto", F.sum("size").over(upto))
        .join(times, "time")
        .withColumn("part", F.least("size", F.col("budget") - (F.col("earlier") + F.col("upto") - F.col("size"))))
        .filter("part > 0")
        .groupBy("row")
        .agg(F.sum("part").alias("taken"), F.count("*").alias("copies"))
    )
    return (
        base.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
        .join(sized_broadcast(key(plan)), ["_s", "_n"])
        .join(taken, "row", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), "content")
    )


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs`` with one row for each copy taken. Rows that are equal in id, source and text share their
    copies evenly, the first ones rounded up; see ``mix`` for nulls and empty texts. Columns may have any names."""
    mixed = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    names = fresh(docs.columns, "__id", "__source", "__content", "__copies", "__rows", "__copy")
    id_, from_, content, copies, rows, copy = names
    keys = [F.coalesce("doc_id", F.lit(NULL_ID)).alias(id_), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias(from_), F.col("content").alias(content)]
    mixed = mixed.groupBy(*keys).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0)
    own = [F.coalesce(col(doc_id).cast("long"), F.lit(NULL_ID)), F.coalesce(F.concat(F.lit("s"), col(source).cast("string")), F.lit("")), F.xxhash64(F.coalesce(col(text), F.lit("")))]
    marked = docs.withColumns(dict(zip((id_, from_, content), own, strict=True)))
    once = marked.join(mixed.filter(F.col(rows) == 1), [id_, from_, content])
    several = mixed.filter(F.col(rows) > 1)
    if several.limit(1).count():  # equal rows: number them, and deal the copies out
        among = Window.partitionBy(id_, from_, content).orderBy(F.lit(0))
        dealt = marked.join(several, [id_, from_, content]).withColumn(copy, F.row_number().over(among))
        share = F.floor((F.col(copies) + F.col(rows) - F.col(copy)) / F.col(rows))
        once = once.union(dealt.withColumn(copies, share).filter(F.col(copies) > 0).drop(copy))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*map(col, docs.columns))
