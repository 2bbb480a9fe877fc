"""Document fingerprints from closed syncmers. DataFrame functions only.

Words are hashed; of each run of K words, the S-word runs inside it are compared, and the K-run is an anchor if the
smallest of them is its first or its last. That depends on nothing outside the K words, so equal passages have equal
anchors wherever they stand. A fingerprint has all anchors of its text, about half as many as the text has words, and
their word positions.

Text without spaces has words too: a run of more than WORD characters stands for those of its strings of GRAM
characters (fewer at its end) whose hash is 0 modulo SHARE, so an insertion changes only the strings that hold it.
Words say little about a short text: one of at most SHORT characters also has anchors of characters, by which two
such texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize, others, sid, sized_broadcast

K, S = 5, 2
#: Longest word; length of the strings that stand for a longer one, of which one in SHARE does.
WORD, GRAM, SHARE = 16, 8, 4
#: Longest text with anchors of characters, their length and that of the runs inside them.
SHORT, SIGNS_K, SIGNS_S = 320, 4, 2
#: Shared anchors count if their positions differ by at most so many words, or by SLOPE of the larger position.
SLACK, SLOPE = 32, 0.2
#: Rows of a range of documents in which neighbours are found, and the ranges that one cut makes (a power of two).
RANGE_ROWS, RANGES = 1000, 4096
#: Crowded ranges whose cuts one broadcast holds (32 kB each).
CUTS_SENT = 1000


#: Group 1: a word behind its white space, or the string that begins at each character of a longer one.
_TOKENS = rf"(?=(\s\S{{1,{WORD}}}(?!\S)|\S{{1,{GRAM}}}))(?:\s\S{{1,{WORD}}}(?!\S)|\S)"


def _anchors(hashes: str, pairs: str, k: int, s: int) -> Column:
    """Closed syncmers of ``hashes`` as structs of h and p (their place), sorted; ``pairs``: hashes of its runs of ``s``."""
    inner = k - s + 1
    at = lambda i, o: F.get(F.col(pairs), i + o)

    def anchored(i: Column) -> Column:
        least = F.least(*[at(i, o) for o in range(inner)])
        return (at(i, 0) == least) | (at(i, inner - 1) == least)

    places = F.filter(F.sequence(F.lit(0), F.size(hashes) - k), anchored)
    anchors = F.transform(places, lambda i: F.struct(F.xxhash64(*[at(i, o) for o in range(inner)]).alias("h"), i.alias("p")))
    one = F.array(F.struct(F.xxhash64(F.col(hashes)).alias("h"), F.lit(0).alias("p")))
    none = F.expr("cast(array() as array<struct<h:bigint,p:int>>)")
    return F.when(F.size(hashes) >= k, F.sort_array(anchors)).when(F.size(hashes) > 0, one).otherwise(none)


def add_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: struct of hashes (array<bigint>, ascending) and places (array<int>) of anchors of words, and of
    sign_hashes and sign_places, the same for characters, empty in texts of more than SHORT characters.

    A null or empty text, or one of white space only, has none; a text of fewer than K words (SIGNS_K characters
    without white space) has one anchor, for all of them, and so has a text for whose long words no string stands.
    Of equal anchors the first place counts. Equal texts have equal fingerprints.
    """
    names = fresh(docs.columns, "__words", "__pairs", "__anchors", "__signs", "__sign_pairs", "__sign_anchors")
    words, pairs, anchors, signs, sign_pairs, sign_anchors = names
    whole = F.coalesce(col(text), F.lit(""))
    spaced = F.regexp_extract_all(F.concat(F.lit(" "), whole), F.lit(_TOKENS), F.lit(1))
    # White space begins the words: 9 to 13 and 32. Strings are taken by their hash.
    hashes = F.transform(spaced, lambda t: F.when(F.ascii(t).isin(9, 10, 11, 12, 13, 32), F.xxhash64(F.substring(t, 2, WORD))).otherwise(F.when(F.pmod(F.xxhash64(t), F.lit(SHARE)) == 0, F.xxhash64(t))))
    step = docs.withColumn(words, F.filter(hashes, lambda h: h.isNotNull()))
    step = step.withColumn(words, F.when((F.size(words) == 0) & F.rlike(whole, F.lit(r"\S")), F.array(F.xxhash64(whole))).otherwise(F.col(words)))
    characters = F.regexp_extract_all(F.when(F.length(whole) <= SHORT, whole).otherwise(""), F.lit(r"\S"), F.lit(0))
    step = step.withColumn(signs, F.transform(characters, lambda c: F.xxhash64(c)))
    for own, two in ((words, pairs), (signs, sign_pairs)):
        step = step.withColumn(two, F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumns({anchors: _anchors(words, pairs, K, S), sign_anchors: _anchors(signs, sign_pairs, SIGNS_K, SIGNS_S)})
    first = lambda c: F.filter(c, lambda x, i: (i == 0) | (x["h"] != F.get(F.col(c), i - 1)["h"]))
    step = step.withColumns({c: first(c) for c in (anchors, sign_anchors)})
    made = F.struct(*[F.col(f"{c}.{f}").alias(n) for c, f, n in ((anchors, "h", "hashes"), (anchors, "p", "places"), (sign_anchors, "h", "sign_hashes"), (sign_anchors, "p", "sign_places"))])
    return step.select(*map(col, others(docs.columns, out)), made.alias(out))


def as_string(fingerprint: str) -> Column:
    """hash:place of each anchor in order of the hashes, comma-joined, in hexadecimal; after a | those of characters, if any."""
    parts = []
    for kind in ("", "sign_"):
        h, p = (F.col(f"{fingerprint}.{kind}{x}") for x in ("hashes", "places"))
        parts.append(F.lower(F.array_join(F.zip_with(h, p, lambda a, b: F.concat_ws(":", F.hex(a), F.hex(b))), ",")))
    return F.when(parts[1] == "", parts[0]).otherwise(F.concat_ws("|", *parts))


def likeness(a: str, b: str) -> Column:
    """Share of anchors in common, 0 to 1, at matching places; 1 for two empty fingerprints, 0 for one. Anchors of characters
    are compared if both have some, else those of words.

    With J the share of the anchors of either that both have, 2 J / (1 + J) is intersection to mean size.
    """
    signs = (F.size(f"{a}.sign_hashes") > 0) & (F.size(f"{b}.sign_hashes") > 0)
    ha, hb, pa, pb = (F.when(signs, F.col(f"{x}.sign_{y}")).otherwise(F.col(f"{x}.{y}")) for y in ("hashes", "places") for x in (a, b))
    pairs = lambda h, p: F.zip_with(h, p, lambda x, y: F.struct(x.alias("h"), y.alias("p")))

    def compared(merged: Column) -> Column:
        # A fingerprint has a hash once: neighbours with equal hashes are one of each.
        def common(x: Column, i: Column) -> Column:
            return (i > 0) & (x["h"] == F.get(merged, i - 1)["h"])

        def near(x: Column, i: Column) -> Column:
            p, q = F.get(merged, i - 1)["p"], x["p"]  # p <= q
            return common(x, i) & (q - p <= F.greatest(F.lit(SLACK).cast("double"), q * SLOPE))

        return F.size(F.filter(merged, near)) / (F.size(merged) - F.size(F.filter(merged, common)))

    # The merged array is bound to a name by transform: written out inside it would be sorted again for each anchor.
    j = F.element_at(F.transform(F.array(F.sort_array(F.concat(pairs(ha, pa), pairs(hb, pb)))), compared), 1)
    return F.when((F.size(ha) == 0) & (F.size(hb) == 0), F.lit(1.0)).when((F.size(ha) == 0) | (F.size(hb) == 0), F.lit(0.0)).otherwise(2 * j / (1 + j))


def _place(bounds: Column, value: Column) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length() + 2))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value), at + step).otherwise(at))


def with_ranges(docs: DataFrame, id_: str, hash_: str, out: str) -> DataFrame:
    """``docs`` with ``out``: a number (bigint) of the range of the row, about RANGE_ROWS rows each, in the order of id and
    hash (a bigint that isn't null).

    Ranges are cut at quantiles of the ids, however they are spread; ranges that still hold too many rows are cut
    again in the same way, and rows that share one id by their hashes.
    """
    ids = materialize(docs.select(F.col(id_).alias("id"), F.col(hash_).alias("hash")), "fingerprint-ids")
    n = ids.count()
    cuts = F.lit([]).cast("array<bigint>")
    if n > RANGE_ROWS:
        k = min(RANGES, n // RANGE_ROWS)
        cuts = F.lit(sorted({int(x) for x in ids.agg(F.percentile_approx("id", [i / k for i in range(1, k)] or [0.5], 10 * RANGES)).first()[0]})).cast("array<bigint>")
    first = lambda i: _place(cuts, i)
    again = ids.withColumn("one", first(F.col("id"))).groupBy("one").agg(F.count("*").alias("rows"), F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    again = again.filter(F.col("rows") > 4 * RANGE_ROWS).select("one", F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(RANGES - 1), F.col("rows") / RANGE_ROWS).cast("int")), lambda i: F.get("cuts", F.floor(i * F.lit(RANGES) / (F.least(F.lit(RANGES - 1), F.col("rows") / RANGE_ROWS).cast("int") + 1)).cast("int") - 1))).alias("cuts"))
    # Ids that many rows share get cuts of their own, before and after them.
    heavy = ids.groupBy("id").count().filter(F.col("count") > 4 * RANGE_ROWS).withColumn("one", first(F.col("id")))
    heavy = heavy.groupBy("one").agg(F.flatten(F.collect_list(F.array("id", F.col("id") + 1))).alias("more"))
    again = materialize(again, "fingerprint-cuts").join(materialize(heavy, "fingerprint-heavy"), "one", "left")
    again = materialize(again.select("one", F.array_sort(F.array_distinct(F.concat("cuts", F.coalesce("more", F.expr("cast(array() as array<bigint>)"))))).alias("cuts")), "fingerprint-cuts")
    second = lambda c, i: F.coalesce(_place(c, i), F.lit(0))
    # Keys are compared as structs: Spark would carry the search over to the other side of a join on plain columns.
    same = lambda *pairs: F.struct(*[F.col(a) for a, _ in pairs]) == F.struct(*[F.col(b) for _, b in pairs])
    cut_again = sized_broadcast(again.select(F.col("one").alias("one_"), "cuts"), limit=1000)
    crowded = (
        ids.withColumn("one", first(F.col("id"))).join(cut_again, same(("one", "one_"))).withColumn("two", second(F.col("cuts"), F.col("id")))
        .groupBy("one", "two").agg(F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        .filter((F.col("rows") > 4 * RANGE_ROWS) & (F.col("lo") == F.col("hi")))
        .select("one", "two", F.ceil(F.col("rows") / RANGE_ROWS).alias("parts"))
    )
    crowded = materialize(crowded, "fingerprint-crowded")
    one, two, one_, two_, cuts_, parts, more = fresh([*docs.columns, out], "__one", "__two", "__one_", "__two_", "__cuts", "__parts", "__more")
    parts_of_cuts = -(-again.count() // CUTS_SENT)
    cut_again, crowded = again.select(F.col("one").alias(one_), F.col("cuts").alias(cuts_)), crowded.select(F.col("one").alias(one_), F.col("two").alias(two_), F.col("parts").alias(parts))
    placed = docs.withColumn(one, first(F.col(id_))).withColumn(cuts_, F.lit(None).cast("array<bigint>"))
    # At most RANGES rows of 32 kB each, sent in parts: the texts stay where they are.
    for part in range(parts_of_cuts):
        sent = cut_again.filter(F.pmod(one_, F.lit(parts_of_cuts)) == part).withColumnRenamed(cuts_, more)
        placed = placed.join(F.broadcast(sent), same((one, one_)), "left").withColumn(cuts_, F.coalesce(cuts_, more)).drop(one_, more)
    placed = placed.withColumn(two, second(F.col(cuts_), F.col(id_))).join(sized_broadcast(crowded), same((one, one_), (two, two_)), "left").drop(one_, two_)
    three = F.coalesce(F.least(F.floor((F.col(hash_) / F.lit(2.0**64) + 0.5) * F.col(parts)), F.col(parts) - 1), F.lit(0)).cast("bigint")
    number = (F.col(one).cast("bigint") * (8 * RANGES) + F.col(two)) * F.lit(1 << 36) + three
    return placed.withColumn(out, number).drop(one, two, cuts_, parts)


def with_next(docs: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> DataFrame:
    """``docs`` (with doc_id and text) and next_<column>: the columns of the next row by doc_id; after the last, the first.

    A null doc_id comes before all others; rows that share a doc_id go by the hash of their text, equal rows in any
    order. An empty table gives an empty result. Each range of ids gets a copy of the row that begins the next one, so
    one shuffle of the rows finds all neighbours. ``make`` adds columns after that shuffle, so that they need not be part
    of it. Columns may have any names; those named like an output are replaced.
    """
    outputs = [f"next_{c}" for c in columns]
    docs = docs.select(*map(col, others(docs.columns, *outputs)))
    id_, hash_, range_, before, copy, extra = fresh(docs.columns, "__id", "__hash", "__range", "__before", "__copy", "__extra")
    docs = docs.withColumn(id_, sid("doc_id")).withColumn(hash_, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    docs = with_ranges(docs, id_, hash_, range_)
    firsts = docs.groupBy(range_).agg(F.min(F.struct(F.col(id_).alias("i"), F.col(hash_).alias("h"))).alias("first")).select(range_, F.col("first.i").alias(id_), F.col("first.h").alias(hash_))
    around = Window.orderBy(range_)
    everything = Window.partitionBy(F.lit(0))
    firsts = materialize(firsts.withColumn(before, F.coalesce(F.lag(range_).over(around), F.max(range_).over(everything))), "fingerprint-firsts")
    marked = docs.join(sized_broadcast(firsts), [range_, id_, hash_], "left")  # a row for about RANGE_ROWS rows
    own = F.struct(F.col(range_).alias("range"), F.lit(0).alias("extra"))
    copied = marked.withColumn(copy, F.explode(F.when(F.col(before).isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col(before).alias("range"), F.lit(1).alias("extra"))))))
    copied = copied.withColumn(range_, F.col(f"{copy}.range")).withColumn(extra, F.col(f"{copy}.extra"))
    copied = make(copied.repartition(range_))
    order = Window.partitionBy(range_).orderBy(extra, id_, hash_)
    return copied.withColumns({f"next_{c}": F.lead(col(c)).over(order) for c in columns}).filter(F.col(extra) == 0).drop(id_, hash_, range_, before, copy, extra)
