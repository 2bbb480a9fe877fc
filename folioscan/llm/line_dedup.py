"""Lines repeated across documents, found with two Bloom filters.

The hash range of lines is cut into segments. A first pass sends each segment the different line hashes of each task;
the segment's once-seen filter learns them, and those that it knew already are seen twice. The twice-seen filter holds
only these, so it is small against the corpus; it is sent to all tasks, in several rounds where it is too large for
one. A second pass keeps only lines that the twice-seen filter knows; only these are shuffled, as whole keys, to count
their documents exactly and to choose the one that keeps the line. False positives cost a row in that shuffle and
nothing else. The lines that go are then dropped where the texts are, without a shuffle of texts, as long as their
table is small enough to be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, WS_CHARS, col, distinct, fresh, map_text, materialize, others, release, sid, skew_safe_left_join

#: Bits of a hash that a filter sets, bits that it has for each hash, lines of a segment.
HASHES, BITS, SEGMENT_LINES = 4, 10, 2_000_000
#: Bytes of the twice-seen filter that are sent to all tasks at once; a larger one goes in rounds.
ROUND_BYTES = 1 << 25
#: Line hashes that a task holds before it passes them on, and repeated lines that are sent to all tasks (24 bytes each).
CHUNK, MOST_SENT = 4_000_000, 1_000_000


def line_key(line: str) -> bytes:
    """The line without white space at both ends, A-Z in lower case, in UTF-8."""
    return line.strip(WS_CHARS).encode("utf-8", "surrogatepass").lower()


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct keys of the text's lines with at least ``min_chars`` code points."""
    found = {s: None for line in (text or "").split("\n") if len(s := line.strip(WS_CHARS)) >= min_chars}
    return list({s.encode("utf-8", "surrogatepass").lower(): None for s in found})


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of each key's 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _places(hashes: np.ndarray, masks: np.ndarray | np.uint64) -> np.ndarray:
    """HASHES places of each hash in a filter of ``masks`` + 1 bits."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(1, HASHES + 1, dtype=np.uint64)) & np.broadcast_to(np.asarray(masks, np.uint64), hashes.shape)[:, None]


def _width(hashes: int) -> int:
    """Bits of a filter, a power of two and 64 at least."""
    return 1 << max(6, (BITS * hashes - 1).bit_length())


class Bloom:
    """A filter in segments: all bits in one array."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.segments, self.masks, self.starts = segments, np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
        self.present, at = np.zeros(segments, bool), 0
        for s, bits in parts.items():
            self.present[s], self.masks[s], self.starts[s] = True, 8 * len(bits) - 1, at
            at += 8 * len(bits)
        self.bits = np.frombuffer(b"".join(parts.values()) or b"\0" * 8, np.uint8)

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        part = _segment(hashes, self.segments)
        at = _places(hashes, self.masks[part]) + self.starts[part][:, None]
        at[~self.present[part]] = 0
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1) & self.present[part]

    @staticmethod
    def packed(hashes: np.ndarray) -> bytes:
        bits = np.zeros(_width(len(hashes)), bool)
        bits[_places(hashes, np.uint64(len(bits) - 1)).ravel()] = True
        return np.packbits(bits, bitorder="little").tobytes()


def twice_seen(docs: DataFrame, min_chars: int, lines: int) -> tuple[DataFrame, int]:
    """(segment, hashes): those that the once-seen filters knew when they came again; and the number of segments."""
    segments = max(16, lines // SEGMENT_LINES + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(_segment(values, segments), np.arange(segments + 1))
            rows = [(s, values[a:b].tobytes(), values[a:b][counts[a:b] > 1].tobytes()) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "once", "twice"])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = _digests([k for x in batch.column(0).slice(at, SLICE).to_pylist() for k in _keys(x, min_chars)])[:, 0]
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield passed(held)
                    held, size = [], 0
        if size:
            yield passed(held)
        release()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(_width(sum(map(len, pdf.once)) // 8), bool), []
        mask = np.uint64(len(once) - 1)
        for a, b in zip(pdf.once, pdf.twice, strict=True):
            new = np.frombuffer(a, np.uint64)
            at = _places(new, mask)
            again += [new[once[at].all(1)], np.frombuffer(b, np.uint64)]
            once[at.ravel()] = True
        return pd.DataFrame({"segment": pdf.segment.iloc[:1], "hashes": [distinct(np.concatenate(again)).tobytes()]})

    parts = docs.select("text").mapInArrow(run, "segment int, once binary, twice binary")
    return materialize(parts.groupBy("segment").applyInPandas(merge, "segment int, hashes binary"), "line-twice"), segments


def suspects(docs: DataFrame, twice: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(doc_id, place, hi, lo, key): lines that the twice-seen filter knows, each once a row of ``docs``."""
    total = twice.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0] // 8
    rounds = _width(total) // 8 // ROUND_BYTES + 1

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Bloom.packed(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["segment", "bits"])

    found = []
    for r in range(rounds):
        parts = twice.filter((F.col("segment") % rounds == r) & (F.octet_length("hashes") > 0)).select("segment", "hashes")
        known = {x.segment: bytes(x.bits) for x in parts.mapInArrow(pack, "segment int, bits binary").toLocalIterator()}  # ROUND_BYTES or so
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bloom = Bloom(segments, shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part, keys, owners = batch.slice(at, SLICE), [], []
                    for n, x in enumerate(part.column(1).to_pylist()):
                        new = _keys(x, min_chars)
                        keys += new
                        owners += [n] * len(new)
                    digests = _digests(keys)
                    chosen = np.flatnonzero(bloom.knows(digests[:, 0]))
                    hi, lo = digests[chosen].view(np.int64).T
                    rows = pa.array([owners[i] for i in chosen], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(hi), pa.array(lo), pa.array([keys[i] for i in chosen], pa.binary())], names=["doc_id", "place", "hi", "lo", "key"])

        found.append(materialize(docs.mapInArrow(run, "doc_id long, place long, hi long, lo long, key binary"), "line-suspects"))
        shared.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _place_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(col(text), F.lit("")))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables: (key, hi, lo, docs, keeper) of lines of at least ``min_docs`` documents, and all suspects
    (doc_id, place, hi, lo, key); ``place`` is the hash of the text, as rows may share an id."""
    docs = docs.select(sid(doc_id).alias("doc_id"), col(text).alias("text"), _place_of(text).alias("place"))
    lines = docs.agg(F.count("*") + F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))).first()[0] or 1
    found = suspects(docs, *twice_seen(docs, min_chars, int(lines)), min_chars)
    chosen = F.max("doc_id") if keep == "last" else F.min("doc_id")
    groups = found.groupBy("key").agg(F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.count("*").alias("docs"), chosen.alias("keeper"))
    return materialize(groups.filter(F.col("docs") >= min_docs), "line-groups"), found


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the remaining lines in ``text`` and two more columns, n_lines (before) and n_dropped (long).

    Lines end at \\n; a null or empty text is one empty line (and stays an empty text). Keys (``line_key``) of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the
    document with the largest doc_id (``keep='first'``: the smallest). Rows are the documents; a null doc_id sorts
    before all others, and rows that share a doc_id all keep the line if it is theirs. An empty table gives an empty
    result. Other columns pass through, whatever they are called; those named like an output are replaced.
    """
    groups, found = repeated_lines(docs, min_chars, min_docs, keep, doc_id, text)
    out = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(text, T.StringType())]
    kept = others(docs.columns, *[f.name for f in out])
    id_, place, pair, keys = fresh(docs.columns, "__id", "__place", "__pair", "__keys")
    if groups.count() <= MOST_SENT:
        return _drop_in_place(docs, groups, min_chars, kept, out, pair, doc_id, text)
    lost = skew_safe_left_join(found, groups.select("key", "docs", "keeper"), ["key"], "docs").filter("keeper is not null and doc_id <> keeper")
    # By id and text, so that a set never holds more lines than one text has.
    lost = materialize(lost.groupBy("doc_id", "place").agg(F.collect_set("key").alias("__keys")), "line-drops").select(F.col("doc_id").alias(id_), F.col("place").alias(place), F.col("__keys").alias(keys))
    joined = docs.withColumn(id_, sid(doc_id)).withColumn(place, _place_of(text)).join(lost, [id_, place], "left").select(*map(col, kept), F.struct(col(text).alias("text"), F.col(keys).alias("keys")).alias(pair))

    def make():
        def one(row: dict) -> tuple[int, int, str]:
            lines = (row["text"] or "").split("\n")
            gone = set(row["keys"] or ())
            left = [x for x in lines if line_key(x) not in gone] if gone else lines
            return len(lines), len(lines) - len(left), "\n".join(left)

        return lambda rows: tuple(zip(*map(one, rows), strict=True)) or ([], [], [])

    return map_text(joined, make, pair, out).drop(pair)


def _drop_in_place(docs: DataFrame, groups: DataFrame, min_chars: int, kept: list[str], out: list[T.StructField], pair: str, doc_id: str, text: str) -> DataFrame:
    table = groups.select("hi", "lo", "keeper").toArrow()  # MOST_SENT rows at most
    hi, lo, keeper = (table.column(c).to_numpy() for c in ("hi", "lo", "keeper"))
    order = np.lexsort((lo.view(np.uint64), hi.view(np.uint64)))
    shared = docs.sparkSession.sparkContext.broadcast((hi.view(np.uint64)[order], lo.view(np.uint64)[order], keeper[order]))

    def make():
        his, los, keepers = shared.value

        def apply(rows: list[dict]):
            split = [(r["text"] or "").split("\n") for r in rows]
            where, keys = [], []
            for i, lines in enumerate(split):
                for j, line in enumerate(lines):
                    if len(s := line.strip(WS_CHARS)) >= min_chars:
                        where.append((i, j))
                        keys.append(s.encode("utf-8", "surrogatepass").lower())
            gone: dict[int, set[int]] = {}
            if keys and len(his):
                digests = _digests(keys)
                at, end = np.searchsorted(his, digests[:, 0]), np.searchsorted(his, digests[:, 0], "right")
                for k in np.flatnonzero(at < end):
                    for m in range(at[k], end[k]):
                        i, j = where[k]
                        if los[m] == digests[k, 1] and keepers[m] != rows[i]["id"]:
                            gone.setdefault(i, set()).add(j)
            left = ["\n".join(x for j, x in enumerate(lines) if j not in gone[i]) if i in gone else rows[i]["text"] or "" for i, lines in enumerate(split)]
            return [len(x) for x in split], [len(gone.get(i, ())) for i in range(len(split))], left

        return apply

    rows = docs.select(*map(col, kept), F.struct(col(text).alias("text"), sid(doc_id).alias("id")).alias(pair))
    return map_text(rows, make, pair, out).drop(pair)
