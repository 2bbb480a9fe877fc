"""Keyword queries: parsing, boolean matching with fallback, ranking, and hits with passages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.snippet import among, by_stem, passage, window
from ..functions.stemmer import singular, stem
from ..functions.words import QUERY_STOP_WORDS, fold, fold_text, is_stop_word, light_stem, split_words, words
from ..plans.postings import STEMMERS, phrases, scored
from ..sources.tables import lookup

DEFAULT_LIMIT = 10
#: Texts (of 3 MB at most) that are sent to the tasks which show them; more are joined by a shuffle.
MOST_SENT = 50


@dataclass(frozen=True)
class Query:
    """Words of a query with their stems, and the stems without accents (for passages)."""

    terms: tuple[str, ...]
    stems: tuple[str, ...]
    folded: tuple[str, ...]
    stemmer: str = "french"


def parse_query(text: str, stemmer: str = "french") -> Query:
    """Distinct words in order, without stop words and query fillers; if none is left, all words of two characters up."""
    every = [text[s:e].lower() for s, e in split_words(text)]
    terms = [w for w in every if not is_stop_word(w) and w not in QUERY_STOP_WORDS] or [w for w in every if len(w) >= 2]
    terms = tuple(dict.fromkeys(terms))
    stems = tuple(map(stem if stemmer == "french" else singular, terms))
    return Query(terms, stems, tuple(map(fold_text, stems)), stemmer)


def worth_searching(text: str) -> bool:
    """Whether a search box should search yet: two characters without the space around them."""
    return len(text.strip()) >= 2


def matching(posted: DataFrame, lengths: DataFrame, query: Query, mode: str = "fallback", totals=None) -> tuple[DataFrame, bool]:
    """((file_id, n_terms, score), every_word).

    mode ``and``: files with every word; ``or``: with any; ``fallback``: with every word, or with any if no file has
    all of several. A word is in a file if a name token begins with it or a stem token with its stem.
    """
    found = scored(posted, lengths, phrases(query.terms, query.stems), totals)
    wanted = len(query.terms)
    if mode == "or" or not wanted:
        return found, not wanted or wanted == 1
    whole = found.filter(F.col("n_terms") == wanted)
    if mode == "and" or wanted == 1:
        return whole, True
    best = found.agg(F.max("n_terms")).first()[0] or 0  # one number; decides which filter applies
    return (whole, True) if best == wanted else (found, False)


def ranked(found: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files: those with text first, then by score, then by id. Adds rank.

    Scores are compared at nine decimals, so that sums in another order don't change the ranking.
    """
    order = [F.desc("has_text"), F.desc(F.round("score", 9)), F.asc("file_id")]
    top = found.join(files.select(F.col("id").alias("file_id"), (F.col("status") == "ok").alias("has_text")), "file_id").orderBy(*order).limit(limit)
    # A result has few rows, so ranking them in one task is what sorting them has come to already.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hits(top: DataFrame, files: DataFrame, texts: DataFrame, query: Query, limit: int) -> DataFrame:
    """path, name, ext, size, mtime, snippet, score, rank of the ranked files.

    The ranked rows are collected, ``limit`` of them at most, and their ids looked up: of tables that are kept by id
    (``write_keyed``) only the parts that hold them are read.
    """
    spark, rows = files.sparkSession, top.select("file_id", "score", "rank").limit(limit).collect()
    ids = [r.file_id for r in rows]
    few = F.broadcast(spark.createDataFrame(rows, "file_id long, score double, rank int"))
    found = lookup(files, "id", ids).withColumnRenamed("id", "file_id").join(few, "file_id")
    bodies = with_passages(lookup(texts, "file_id", ids), query)
    bodies = F.broadcast(bodies) if len(ids) <= MOST_SENT else bodies
    shown = found.join(bodies, "file_id", "left")
    return shown.select("path", "name", "ext", "size", "mtime", "snippet", "score", "rank").orderBy("rank")


def with_passages(texts: DataFrame, query: Query) -> DataFrame:
    """(file_id, snippet) of (file_id, body): the passage of each text, null if it has none of the words.

    Words are matched by stems. Where these are no Column function, the different words of the texts (of a result), and
    then those of the windows, as these may begin and end within a word, are stemmed in rows of their own.
    """
    if query.stemmer == "light":
        matches = by_stem(light_stem, query.folded)
        return texts.select("file_id", passage(window(F.col("body"), matches), matches).alias("snippet"))
    whole = _with_found(texts.select("file_id", "body"), F.col("body"), query)
    shown = whole.select("file_id", window(F.col("body"), among(F.col("found"))).alias("shown"))
    return _with_found(shown, F.col("shown.text"), query).select("file_id", passage(F.col("shown"), among(F.col("found"))).alias("snippet"))


def _with_found(rows: DataFrame, text: Column, query: Query) -> DataFrame:
    """``rows`` with ``found``: the different words of their text that match."""
    word = rows.select("file_id", F.explode(F.array_distinct(words(text))).alias("word"))
    stemmed = word.withColumn("stem", fold(STEMMERS[query.stemmer](F.col("word"))))
    matched = stemmed.filter(reduce(or_, [F.col("stem").startswith(s) for s in query.folded], F.lit(False)))
    return rows.join(matched.groupBy("file_id").agg(F.collect_set("word").alias("found")), "file_id", "left")
