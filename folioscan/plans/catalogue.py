"""The registered queries of the search engine, over the driver's tables, and DuckDB SQL for the same rows.

``documents`` become text files (root: the source), ``part`` names become pictures that are known by name only, and
``pages`` are HTML sources. Searches use the light stemmer where SQL has to agree, the French one in search_stemmed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, markup, words
from ..operators import search
from ..operators.index import SearchIndex
from ..operators.search import matching, parse_query, ranked
from ..sources import names, tables
from ..streaming.follow import EVENT, follow_documents
from . import blocks as K
from . import postings as P
from . import sync as S

MTIME = 1_700_000_000
#: Queries of the registered searches.
BOTH, ANY, NOWHERE = "edinst onst", "edinst lyer quees", "the onst zzzqqq"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.lit("txt").alias("ext"),
        F.col("n_chars").alias("size"),
        (F.lit(MTIME) + F.col("doc_id")).alias("mtime"),
        F.lit("ok").alias("status"),
        F.concat(F.lit("/"), "source").alias("root"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("body"))


def part_files(spark: SparkSession, sf_dir: str, first: int = 1_000_000_000) -> DataFrame:
    name = F.concat("p_name", F.lit(".png"))
    return _table(spark, sf_dir, "part").select(
        (F.lit(first) + F.col("p_partkey")).alias("id"),
        F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.lit("png").alias("ext"),
        F.lit(16).cast("long").alias("size"),
        F.lit(MTIME).cast("long").alias("mtime"),
        F.lit("name_only").alias("status"),
        F.lit("/parts").alias("root"),
    )


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).unionByName(part_files(spark, sf_dir))


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.explode(words.words(F.col("text"))).alias("word"))


def word_counts(spark, sf_dir):
    return _document_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


def stop_filtered_terms(spark, sf_dir):
    return word_counts(spark, sf_dir).filter(words.is_indexed_word(F.col("word")))


def plural_stripped_terms(spark, sf_dir):
    return word_counts(spark, sf_dir).groupBy(words.light_stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def accent_folded_terms(spark, sf_dir):
    return word_counts(spark, sf_dir).groupBy(words.fold(F.col("word")).alias("folded"), words.index_fold(F.col("word")).alias("token")).agg(F.sum("n").alias("n"))


def name_words(spark, sf_dir):
    return all_files(spark, sf_dir).select("id", words.name_words(F.col("name")).alias("name_words"))


def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


def html_entities(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("html", F.lit("&[a-z]+;"), F.lit(0))).alias("entity")
    return _table(spark, sf_dir, "pages").select(found).groupBy("entity").agg(F.count("*").alias("n")).withColumn("decoded", markup.decode_entities(F.col("entity")))


def xml_text(spark, sf_dir):
    body = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<w:document><w:p><w:r><w:t>"), F.replace(body, F.lit("\n"), F.lit("</w:t></w:r></w:p><w:p><w:r><w:tab/><w:t>")), F.lit("</w:t></w:r></w:p><w:sectPr"))
    return _table(spark, sf_dir, "documents").select("doc_id", markup.xml_text(xml).alias("text"))


def _made_names(spark, sf_dir):
    """Names with many endings, from part names: (id, name, is_folder, parent, size)."""
    endings = F.array(*[F.lit(e) for e in NAME_ENDINGS])
    part = _table(spark, sf_dir, "part")
    ending = F.element_at(endings, (F.col("p_partkey") % len(NAME_ENDINGS) + 1).cast("int"))
    whole = F.col("p_partkey") % 3 == 0
    return part.select(
        F.col("p_partkey").alias("id"),
        F.when(whole, ending).otherwise(F.concat("p_name", ending)).alias("name"),
        (F.col("p_partkey") % 2 == 0).alias("is_folder"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("/home/me")).otherwise(F.lit("/data")).alias("parent"),
        (F.col("p_size").cast("long") * 4_000_000).alias("size"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string")).when(F.col("p_partkey") % 5 == 1, F.lit(" \n")).otherwise(F.col("p_name")).alias("text"),
    )


#: Endings, and names of their own, that the file name queries are made of.
NAME_ENDINGS = (
    ".txt", ".PDF", ".docx", ".png", ".pem", "_credentials.csv", ".env.local", "id_rsa", ".app", "node_modules", "Library", ".csv",
    " Passwords.csv", "-recovery-codes.txt", ".", ".tar.gz", "AppData", ".html", "bitwarden_export_1.json", ".KEY", "Venv",
)


def sensitive_names(spark, sf_dir):
    return _made_names(spark, sf_dir).select("id", "name", names.is_secret(F.col("name")).alias("sensitive"))


def excluded_paths(spark, sf_dir):
    made = _made_names(spark, sf_dir)
    return made.select("id", "name", names.is_excluded(F.col("name"), F.col("is_folder"), F.col("parent"), "/home/me").alias("excluded"))


def extension_status(spark, sf_dir):
    made = _made_names(spark, sf_dir).withColumn("ext", names.extension(F.col("name")))
    return made.select("id", "ext", names.is_readable(F.col("ext")).alias("readable"), names.status(F.col("ext"), F.col("size"), F.col("text")).alias("status"))


def roots(spark, sf_dir):
    return S.roots(all_files(spark, sf_dir))


def total_files(spark, sf_dir):
    return S.total_files(roots(spark, sf_dir))


def index_stats(spark, sf_dir):
    return S.stats(all_files(spark, sf_dir), document_texts(spark, sf_dir))


def _snapshots(spark, sf_dir):
    """What the index knows, and the folder now: some files gone, some new, some with another size or time."""
    files, i = document_files(spark, sf_dir), F.col("id")
    known = files.filter(i % 10 != 3).select("id", "path", "size", "mtime")
    now = files.filter(i % 10 != 7).select("path", "name", "ext", F.when(i % 10 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 10 == 2, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"))
    return now, known


def sync_plan(spark, sf_dir):
    return S.changes(*_snapshots(spark, sf_dir)).select("path", "action", "id")


def sync_report(spark, sf_dir):
    return S.report(S.changes(*_snapshots(spark, sf_dir)))


def _documents_in_two_steps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files with text as they are first, and what comes, changes (their text is null where they vanish) afterwards."""
    files, i = document_files(spark, sf_dir).join(document_texts(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("body").alias("text")), "id"), F.col("id")
    longer = F.when(i % 10 == 1, F.concat("text", F.lit(" zzzqqq"))).when(i % 10 != 7, F.col("text"))
    return files.filter(i % 10 != 3), files.filter((i % 10).isin(1, 3, 7)).withColumn("text", longer)


def _index_at(spark) -> SearchIndex:
    return SearchIndex.open(spark, f"{tables.shared_dir(spark).removeprefix('file://')}/index-{uuid.uuid4().hex}", "light")


def _indexed_files(index: SearchIndex) -> DataFrame:
    return index.files.select("path", "size", "mtime", "status", "tokens")


def incremental_index(spark, sf_dir):
    """The files of an index after new, changed and vanished documents were taken into it."""
    index, (first, then) = _index_at(spark), _documents_in_two_steps(spark, sf_dir)
    columns = ["path", "name", "ext", F.length("text").cast("long").alias("size"), "mtime", "status", "root", "text"]
    index.replace(first.select(*columns), first.limit(0))
    index.replace(then.filter("text is not null").select(*columns), then.filter("text is null"))
    return _indexed_files(index)


def streamed_index(spark, sf_dir):
    """The same from a stream of events, some of which repeat and come too late."""
    index, (first, then) = _index_at(spark), _documents_in_two_steps(spark, sf_dir)
    folder = f"{tables.shared_dir(spark)}/events-{uuid.uuid4().hex}"
    event = lambda df, version: df.select("path", F.lit(version).cast("long").alias("version"), "mtime", "root", F.col("text").isNull().alias("gone"), "text")
    for df in (event(first, 1), event(then, 2), event(first.filter(F.col("id") % 10 == 7), 1)):
        df.write.mode("append").parquet(folder)
    follow_documents(spark.readStream.schema(EVENT).parquet(folder), index, f"{folder}-checkpoint").awaitTermination()
    return _indexed_files(index).drop("size")


def known_files(spark, sf_dir):
    return all_files(spark, sf_dir).filter(F.col("root") == "/src1").select("id", "path", "size", "mtime")


def forget_root(spark, sf_dir):
    files, others, gone = S.forget(all_files(spark, sf_dir), {"texts": document_texts(spark, sf_dir)}, "/src1")
    part = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("part"), "n")
    return part(files, "files").unionByName(part(others["texts"], "texts")).unionByName(part(gone, "removed"))


def root_adoption(spark, sf_dir):
    moved = document_files(spark, sf_dir).withColumn("root", S.adopted(F.col("root"), "/", ["/src1", "/src2"]))
    return S.roots(moved)


def root_overlap(spark, sf_dir):
    known = document_files(spark, sf_dir).select("root").distinct()
    asked = F.explode(F.array(*[F.lit(r) for r in ("/src1", "/src1/deeper", "/src10", "/", "/other")])).alias("asked")
    pairs = known.select("root", asked)
    folder = F.when(F.col("asked") == "/", F.lit("")).otherwise(F.col("asked"))
    return pairs.select("root", "asked", S.below(F.col("asked"), F.col("root")).alias("rejected"), S.below(F.col("root"), folder).alias("adopted"))


def status_migration(spark, sf_dir):
    olds = F.array(*[F.lit(s) for s in (*names.OLD_STATUSES, "ok")])
    old = F.element_at(olds, (F.col("doc_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", names.migrated(old).alias("status"))


def posting_list(spark, sf_dir):
    return P.postings(document_files(spark, sf_dir), document_texts(spark, sf_dir), "light")


def doc_lengths(spark, sf_dir):
    files = all_files(spark, sf_dir)
    return P.lengths(files, P.postings(files, document_texts(spark, sf_dir), "light"))


def doc_freq(spark, sf_dir):
    q = parse_query(ANY, "light")
    counts = P.phrase_counts(posting_list(spark, sf_dir), P.phrases(q.terms, q.stems))
    return P.document_frequencies(counts)


def _search(spark, sf_dir, files: DataFrame, text: str, mode: str, stemmer: str = "light", limit: int = 30) -> DataFrame:
    q, texts = parse_query(text, stemmer), document_texts(spark, sf_dir)
    posted = P.postings(files, texts, stemmer)
    found, every = matching(posted, P.lengths(files, posted), q, mode)
    top = ranked(found, files, limit)
    return top.select("rank", F.col("file_id").alias("id"), F.col("n_terms"), F.round("score", 6).alias("score"), F.lit(every).alias("every_word"))


def search_and(spark, sf_dir):
    return _search(spark, sf_dir, document_files(spark, sf_dir), BOTH, "and")


def search_or(spark, sf_dir):
    return _search(spark, sf_dir, document_files(spark, sf_dir), ANY, "or")


def search_fallback(spark, sf_dir):
    return _search(spark, sf_dir, document_files(spark, sf_dir), NOWHERE, "fallback")


def search_text_before_name_only(spark, sf_dir):
    return _search(spark, sf_dir, all_files(spark, sf_dir), PART_QUERY, "or")


#: Words of part names, which no document has in its text, with a word that some documents have.
PART_QUERY = "blue src1 edinst"


def _search_blocks(spark, sf_dir, files: DataFrame, text: str, mode: str, limit: int = 30) -> DataFrame:
    q = parse_query(text, "light")
    blocked, blocks, totals = K.indexed(files, document_texts(spark, sf_dir), "light")
    top, every = K.best_files(blocked, blocks, q.terms, q.stems, totals, limit, mode)
    return top.select("rank", F.col("file_id").alias("id"), "n_terms", F.round("score", 6).alias("score"), F.lit(every).alias("every_word"))


def search_top_and(spark, sf_dir):
    return _search_blocks(spark, sf_dir, document_files(spark, sf_dir), BOTH, "and")


def search_top_or(spark, sf_dir):
    return _search_blocks(spark, sf_dir, document_files(spark, sf_dir), ANY, "or")


def search_top_fallback(spark, sf_dir):
    return _search_blocks(spark, sf_dir, document_files(spark, sf_dir), NOWHERE, "fallback")


def search_top_text_first(spark, sf_dir):
    return _search_blocks(spark, sf_dir, all_files(spark, sf_dir), PART_QUERY, "or")


def search_many(spark, sf_dir):
    """What users of conversations say, each turn as a query over documents and pictures."""
    said = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    queries = said.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")
    blocked, totals = K.indexed_postings(all_files(spark, sf_dir), document_texts(spark, sf_dir), "light")
    found = K.best_files_of_many(blocked, queries, totals, 10, "fallback", "light")
    return found.withColumnRenamed("file_id", "id").withColumn("score", F.round("score", 6))


def hit_lookup(spark, sf_dir):
    """Files and whole texts of the hits, looked up in tables that are kept by id."""
    folder, q = f"{tables.shared_dir(spark)}/keyed-{uuid.uuid4().hex}", parse_query(ANY, "light")
    files, texts = all_files(spark, sf_dir), document_texts(spark, sf_dir)
    blocked, blocks, totals = K.indexed(files, texts, "light")
    tables.write_keyed(files, f"{folder}/files", "id", ["path"])
    tables.write_keyed(texts, f"{folder}/texts", "file_id")
    files, texts = (spark.read.parquet(f"{folder}/{n}") for n in ("files", "texts"))
    top, _ = K.best_files(blocked, blocks, q.terms, q.stems, totals, 30, "or")
    ranks = [(r.file_id, r.rank) for r in top.collect()]  # 30 rows
    ids = [i for i, _ in ranks]
    shown = tables.lookup(files, "id", ids).join(tables.lookup(texts, "file_id", ids).withColumnRenamed("file_id", "id"), "id")
    return shown.join(F.broadcast(spark.createDataFrame(ranks, "id long, rank int")), "id").select("rank", "id", "path", "size", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def search_stemmed(spark, sf_dir):
    return _search(spark, sf_dir, document_files(spark, sf_dir), ANY, "or", "french")


def search_hits(spark, sf_dir):
    files, texts, q = document_files(spark, sf_dir), document_texts(spark, sf_dir), parse_query(ANY, "light")
    posted = P.postings(files, texts, "light")
    found, _ = matching(posted, P.lengths(files, posted), q, "or")
    return search.hits(ranked(found, files, 10), files, texts, q, 10).withColumn("score", F.round("score", 6)).withColumn("parts", F.size(display.parts(F.col("snippet")))).drop("snippet", "parts")


def _passages(spark, sf_dir, stemmer: str) -> DataFrame:
    files, texts, q = document_files(spark, sf_dir), document_texts(spark, sf_dir), parse_query(ANY, stemmer)
    blocked, blocks, totals = K.indexed(files, texts, stemmer)
    top, _ = K.best_files(blocked, blocks, q.terms, q.stems, totals, 10, "or")
    shown = search.hits(top, files, texts, q, 10)
    return shown.select("rank", "path", "snippet", display.bold(F.col("snippet")).alias("bold"), F.size(display.parts(F.col("snippet"))).alias("n_parts"))


def search_passages(spark, sf_dir):
    return _passages(spark, sf_dir, "light")


def search_stemmed_passages(spark, sf_dir):
    return _passages(spark, sf_dir, "french")


def all_passages(spark, sf_dir):
    """The passage of every document for one query, whether it is a hit or not."""
    q = parse_query(ANY, "light")
    return search.with_passages(document_texts(spark, sf_dir), q)


def stem_vocabulary(spark, sf_dir):
    """A vocabulary of stems that grows: words of one source first, then those that the other documents add."""
    files, texts = document_files(spark, sf_dir), document_texts(spark, sf_dir)
    of = lambda rows: P.word_rows(rows, texts.join(rows.select(F.col("id").alias("file_id")), "file_id", "left_semi")).filter("col = 'stems'")
    known = tables.written(P.new_stems(of(files.filter("root = '/src1'")), "light"), "stems")
    added = P.new_stems(of(files), "light", known)
    return known.withColumn("step", F.lit(1)).unionByName(added.withColumn("step", F.lit(2)))


def owning_roots(spark, sf_dir):
    """Roots within roots: sources, some of their folders, and two that only begin alike."""
    files = document_files(spark, sf_dir)
    paths = files.select(F.concat("root", F.lit("/"), (F.col("id") % 4).cast("string"), F.lit("/"), (F.col("id") % 3).cast("string"), F.lit("/"), "name").alias("path"))
    roots_ = files.select("root").unionByName(files.filter("id % 4 < 2").select(F.concat("root", F.lit("/"), (F.col("id") % 4).cast("string")).alias("root")))
    roots_ = roots_.unionByName(files.filter("id % 12 = 1").select(F.concat("root", F.lit("/1/1")).alias("root"))).filter("root not like '/src2%'")
    return S.owning_roots(paths, roots_.distinct())


def hit_display(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return files.select(
        "id",
        display.file_size(F.col("size") * 997).alias("size"),
        display.kilobytes(F.col("size")).alias("kb"),
        display.date(F.col("mtime") - F.when(F.col("id") % 7 == 0, F.col("mtime")).otherwise(0)).alias("date"),
        display.short_name(F.col("path")).alias("short_name"),
        display.location(F.concat(F.col("root"), F.lit("/a/b/"), F.col("name")), F.col("root")).alias("location"),
        display.read_in_full(F.col("size"), F.lit(500).cast("long")).alias("read_in_full"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        word_counts, stop_filtered_terms, plural_stripped_terms, accent_folded_terms, name_words, html_text, html_entities, xml_text,
        sensitive_names, excluded_paths, extension_status, roots, total_files, index_stats, known_files, sync_plan, incremental_index, streamed_index, sync_report, forget_root,
        root_adoption, root_overlap, owning_roots, stem_vocabulary, status_migration, posting_list, doc_lengths, doc_freq, search_and, search_or, search_fallback,
        search_text_before_name_only, search_top_and, search_top_or, search_top_fallback, search_top_text_first, search_many,
        search_hits, hit_lookup, search_stemmed, search_passages, search_stemmed_passages, all_passages, hit_display,
    )
}
