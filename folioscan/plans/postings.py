"""The inverted index as tables, and BM25 over it.

postings: (file_id, col, token, tf), where col is ``name`` (words of the file name as they are) or ``stems`` (stems of
the name's and the text's words). lengths: (file_id, n_name, n_stems). Words are counted by file before they are
stemmed, so the shuffle carries counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import stem_column
from ..functions.words import index_fold, index_fold_text, is_indexed_word, light_stem, name_stem, words
from ..sources.tables import sized_broadcast, written

#: Weights of matches in the name and in the stems, and the usual BM25 constants.
WEIGHTS = {"name": 8.0, "stems": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6

STEMMERS: dict[str, Callable[[Column], Column]] = {"french": stem_column, "light": light_stem}


def word_rows(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, col, word): one row for each word occurrence that the index counts, not yet stemmed."""
    named = files.select(F.col("id").alias("file_id"), words(name_stem(F.col("name"))).alias("words"))
    read = texts.select("file_id", words(F.col("body")).alias("words"))
    rows = lambda df, col: df.select("file_id", F.lit(col).alias("col"), F.explode("words").alias("word"))
    return rows(named, "name").unionByName(rows(named.unionByName(read), "stems").filter(is_indexed_word(F.col("word"))))


def new_stems(words_: DataFrame, stemmer: str, known: DataFrame | None = None) -> DataFrame:
    """(word, stem) of the different words in ``words_`` that the vocabulary ``known`` (word, stem) doesn't have yet."""
    different = words_.select("word").distinct()
    if known is not None:
        different = different.join(known.select("word"), "word", "left_anti")
    return different.select("word", STEMMERS[stemmer](F.col("word")).alias("stem"))


def postings(files: DataFrame, texts: DataFrame, stemmer: str = "french", known: DataFrame | None = None) -> DataFrame:
    """Postings of the files. A stemmer that is no Column function sees each different word once, in a vocabulary that is
    written and joined by word; words that the vocabulary ``known`` has are not stemmed again."""
    rows = word_rows(files, texts)
    if stemmer == "light":  # cheaper for each word than a second shuffle of the counts
        token = index_fold(F.when(F.col("col") == "name", F.col("word")).otherwise(light_stem(F.col("word"))))
        return rows.groupBy("file_id", "col", token.alias("token")).agg(F.count("*").alias("tf"))
    counted = written(rows.groupBy("file_id", "col", "word").agg(F.count("*").alias("n")), "index-words")
    name, stems = counted.filter("col = 'name'").withColumn("token", index_fold(F.col("word"))), counted.filter("col = 'stems'")
    vocabulary = written(new_stems(stems, stemmer, known), "index-stems")
    vocabulary = vocabulary if known is None else vocabulary.unionByName(known.select("word", "stem"))
    stems = stems.join(sized_broadcast(vocabulary), "word").withColumn("token", index_fold(F.col("stem"))).drop("stem").select(*counted.columns, "token")
    return name.unionByName(stems).groupBy("file_id", "col", "token").agg(F.sum("n").alias("tf"))


def lengths(files: DataFrame, posted: DataFrame) -> DataFrame:
    """Tokens of each file; files without any count with zero, as they are rows of the index too."""
    sums = posted.groupBy("file_id").agg(*[F.coalesce(F.sum(F.when(F.col("col") == c, F.col("tf"))), F.lit(0)).alias(f"n_{c}") for c in WEIGHTS])
    return files.select(F.col("id").alias("file_id")).join(sums, "file_id", "left").na.fill(0, [f"n_{c}" for c in WEIGHTS])


@dataclass(frozen=True)
class Phrase:
    """A prefix looked up in one column; ``term`` numbers the query word that it belongs to."""

    term: int
    col: str
    prefix: str

    def matches(self) -> Column:
        return (F.col("col") == self.col) & F.col("token").startswith(self.prefix)


def phrases(terms: Sequence[str], stems: Sequence[str]) -> list[Phrase]:
    return [Phrase(i, c, index_fold_text(w)) for i, (t, s) in enumerate(zip(terms, stems, strict=True)) for c, w in (("name", t), ("stems", s))]


def phrase_counts(posted: DataFrame, wanted: Sequence[Phrase]) -> DataFrame:
    """(file_id, phrase, term, weight, tf). The prefixes reach the scan as filters; a token counts for each that it has."""
    any_of = F.lit(False)
    for p in wanted:
        any_of = any_of | p.matches()
    hits = F.array_compact(
        F.array(*[F.when(p.matches(), F.struct(F.lit(i).alias("phrase"), F.lit(p.term).alias("term"), F.lit(WEIGHTS[p.col]).alias("weight"))) for i, p in enumerate(wanted)])
    )
    rows = posted.filter(any_of).select("file_id", "tf", F.explode(hits).alias("p"))
    return rows.groupBy("file_id", F.col("p.phrase").alias("phrase"), F.col("p.term").alias("term"), F.col("p.weight").alias("weight")).agg(F.sum("tf").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("phrase").agg(F.count("*").alias("df"))


def scored(posted: DataFrame, file_lengths: DataFrame, wanted: Sequence[Phrase], totals: tuple[int, float] | None = None) -> DataFrame:
    """(file_id, n_terms, score): files that have a phrase, how many query words they match, and their BM25 score.

    ``totals``: number of files and their mean length, if known already.
    """
    if totals is None:
        totals = file_lengths.agg(F.count("*"), F.avg(F.col("n_name") + F.col("n_stems"))).first()
    n_files, mean = int(totals[0]), float(totals[1] or 0.0) or 1.0
    counts = phrase_counts(posted, wanted)
    idf = F.log((F.lit(float(n_files)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequencies = document_frequencies(counts).select("phrase", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    f = F.col("weight") * F.col("tf")
    norm = K1 * (1 - B + B * (F.col("n_name") + F.col("n_stems")) / F.lit(mean))
    return (
        counts.join(F.broadcast(frequencies), "phrase")  # two rows for each query word
        .join(file_lengths, "file_id")
        .groupBy("file_id")
        .agg(F.count_distinct("term").alias("n_terms"), F.sum(F.col("idf") * f * (K1 + 1) / (f + norm)).alias("score"))
    )
