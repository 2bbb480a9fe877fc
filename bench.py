"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscan.operators.search import matching, parse_query, ranked
from folioscan.plans import catalogue as C
from folioscan.plans import postings as P
from folioscan.plans import sync as S

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
#: Searches are timed warm, as the median of so many runs.
RUNS = 5


def timed(call) -> float:
    began = time.perf_counter()
    call()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, took = tempfile.mkdtemp(prefix="bench-"), {}
    try:
        files, texts = C.all_files(spark, SF), C.document_texts(spark, SF)

        def build() -> None:
            posted = P.postings(files, texts)
            posted.repartitionByRange("col", "token").sortWithinPartitions("col", "token", "file_id").write.parquet(f"{folder}/postings")
            P.lengths(files, spark.read.parquet(f"{folder}/postings")).write.parquet(f"{folder}/lengths")
            files.write.parquet(f"{folder}/files")
            texts.write.parquet(f"{folder}/texts")

        took["index_build"] = timed(build)
        posted, lengths, known = (spark.read.parquet(f"{folder}/{n}") for n in ("postings", "lengths", "files"))
        totals = lengths.agg(F.count("*"), F.avg(F.col("n_name") + F.col("n_stems"))).first()

        def search(text: str, mode: str):
            q = parse_query(text)
            found, _ = matching(posted, lengths, q, mode, totals)
            return ranked(found, known, 30).collect()

        for name, text, mode in (("search_and", C.BOTH, "and"), ("search_or", C.ANY, "or"), ("search_fallback", C.NOWHERE, "fallback")):
            search(text, mode)
            took[name] = median(timed(lambda t=text, m=mode: search(t, m)) for _ in range(RUNS))
        old = known.select("id", "path", "size", "mtime")
        now = known.select("path", "name", "ext", "size", "mtime")
        took["sync_unchanged"] = timed(lambda: S.report(S.changes(now, old)).collect())
        some = now.withColumn("size", F.when(F.xxhash64("path") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")))
        took["sync_tenth_changed"] = timed(lambda: S.report(S.changes(some, old)).collect())
        for name in ("word_counts", "html_text", "index_stats", "posting_list"):
            took[name] = timed(lambda n=name: C.QUERIES[n](spark, SF).write.format("noop").mode("overwrite").save())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()
    took = {k: round(v, 3) for k, v in took.items()}
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
