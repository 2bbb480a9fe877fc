"""Command line: index, search, folders, forget, stats. Exit code 2 for wrong usage, 1 for an error."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.display import bold, kilobytes
from .operators.index import SearchIndex, report_dict

USAGE = """usage:
  folioscan index FOLDER [--db PATH] [--json]
  folioscan search WORDS... [--db PATH] [--limit N] [--json]
  folioscan folders [--db PATH] [--json]
  folioscan forget FOLDER [--db PATH]
  folioscan stats [--db PATH] [--json]"""
DEFAULT_DB = "folioscan-index"


class _Usage(Exception):
    pass


def _options(args: list[str]) -> tuple[list[str], str, int, bool]:
    words, db, limit, as_json, at = [], DEFAULT_DB, 10, False, 0
    while at < len(args):
        if args[at] == "--json":
            as_json = True
        elif args[at] in ("--db", "--limit"):
            if at + 1 >= len(args):
                raise _Usage
            at += 1
            if args[at - 1] == "--db":
                db = args[at]
            elif args[at].isdigit():
                limit = int(args[at])
            else:
                raise _Usage
        else:
            words.append(args[at])
        at += 1
    return words, db, limit, as_json


def _search(index: SearchIndex, text: str, limit: int, as_json: bool) -> str:
    found, every = index.find(text, limit)
    if as_json:
        return json.dumps([json.loads(r) for r in found.drop("rank").toJSON().collect()], indent=2, ensure_ascii=False)
    rows = found.select("rank", "name", "path", kilobytes(F.col("size")).alias("kb"), bold(F.col("snippet")).alias("snippet")).collect()
    if not rows:
        return "No results"
    out = [] if every else ["No file has every word; these have some:"]
    for r in rows:
        out += [f"{r.rank}. {r.name} ({r.kb} KB)", f"   {r.path}", *([f"   {r.snippet}"] if r.snippet else [])]
    return "\n".join(out)


def run(args: list[str], spark: SparkSession | None = None) -> int:
    try:
        if not args:
            raise _Usage
        verb, (words, db, limit, as_json) = args[0], _options(args[1:])
        if verb not in ("index", "search", "folders", "forget", "stats") or (verb in ("index", "search", "forget")) != bool(words):
            raise _Usage
        spark = spark or SparkSession.builder.appName("folioscan").getOrCreate()
        index = SearchIndex.open(spark, db)
        if verb == "index":
            report = report_dict(index.index_folder(words[0]))
            said = json.dumps(report, indent=2) if as_json else ", ".join(f"{k} {v}" for k, v in report.items())
        elif verb == "search":
            said = _search(index, " ".join(words), limit, as_json)
        elif verb == "folders":
            folders = index.roots()
            said = json.dumps([{"files": n, "path": r} for r, n in folders], separators=(",", ":")) if as_json else "\n".join(f"{r} ({n} files)" for r, n in folders)
        elif verb == "forget":
            said = f"{index.forget_root(words[0])} files removed from the index"
        else:
            found = index.stats()
            said = json.dumps(found, indent=2) if as_json else ", ".join(f"{k} {v}" for k, v in found.items())
        print(said)
        return 0
    except _Usage:
        print(USAGE, file=sys.stderr)
        return 2
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
