"""Repeated strings across documents, found with suffix arrays and longest-previous-factor arrays.

Sorting all suffixes of a corpus at once is neither possible in one task nor needed: only strings of ``length`` bytes
that occur twice matter.

1. Anchors. In every window of ``length`` bytes the ``gram_size``-byte string with the smallest hash is an anchor, so equal
   windows have equal anchors. Neighbouring windows with one anchor are a block; each window is in one block.
2. Anchors that occur once are done. Blocks that are equal as a whole are copies of each other throughout.
3. The different blocks of an anchor are cut out of the texts. Blocks of one anchor meet in one task, which sorts
   their suffixes and finds, for each, the longest match that begins earlier (and later) in the corpus: the previous
   and the next smaller position in suffix order are the only candidates.
4. Bytes under a match of ``length`` are removed, from all places or from all but the first.

An anchor with very many different blocks is not compared in one task: its blocks are cut into smaller ones by the
anchors of longer strings, which fewer surroundings share, at last by whole windows. So work grows with the bytes of
the blocks and never with their pairs.

The same goes for passages of words: then a text is the row of its words' 64-bit hashes in place of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, col, distinct, fresh, map_text, materialize, others, release, sid, sized_broadcast, skew_safe_left_join

#: Bytes (or words) of a text that are looked at together, of blocks in a task, and different blocks of an anchor from which on longer
#: anchors tell them apart.
STRETCH, BIN_BYTES, MANY = 1 << 20, 1 << 21, 1000
#: Bytes of the ranges that are sent to all tasks to be cut out of the texts; larger tables are joined by a shuffle.
SENT_BYTES = 1 << 26

def gram_sizes(length: int) -> list[int]:
    """Bytes of an anchor: long enough to be rare, short enough that anchors are far apart; then longer ones, up to a
    whole window."""
    first = max(1, length * 8 // 25)
    return sorted({first, (first + length) // 2, length})


_random = np.random.default_rng(20)
_BYTE = _random.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BACK)):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


class Hashes:
    """Hash of any stretch of some bytes, or words' hashes, in constant time, the same wherever the stretch stands."""

    def __init__(self, data: np.ndarray):
        up, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * up[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def in_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def in_words(text: str | None) -> np.ndarray:
    """Hashes of the words, which white space of the contracts ends."""
    data = in_bytes(text)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(end, base + STRETCH, "right"))
        if to > at:
            out[at:to] = Hashes(data[base : end[to - 1]]).of(start[at:to] - base, end[at:to] - base)
        else:  # a word longer than a stretch
            out[at] = int.from_bytes(blake2b(data[base : end[at]], digest_size=8).digest(), "little")
        at = max(to, at + 1)
    return out


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, from running ones within blocks of ``width``."""
    pick, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    blocks = np.full(-(-n // width) * width, fill, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Columns anchor, block hash, start, end, places: runs of windows of ``length`` bytes with one anchor.

    The anchor of a window is the smallest hash of its ``gram``-byte strings, so every window is in one block and equal
    windows have equal anchors. A block ends with the last byte of its last window. places is over 1 if the text has
    the anchor's string more than once.
    """
    found, width = [], length - gram + 1
    for at in range(0, len(data) - length + 1, STRETCH):
        hashes = Hashes(part := data[at : at + STRETCH + length - 1])
        starts = np.arange(len(part) - gram + 1)
        grams = hashes.of(starts, starts + gram)
        least = _sliding(grams, width, True)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        end = np.r_[first[1:], len(least)] - 1 + length
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.sort(grams[_sliding(np.concatenate([edge, least, edge]), width, False) == grams])
        twice = distinct(chosen[1:][chosen[1:] == chosen[:-1]])
        anchor = least[first]
        places = 1 + np.isin(anchor, twice)
        whole = _mix(hashes.of(first, end) ^ ((end - first).astype(np.uint64) << np.uint64(40)))
        found.append(np.stack([anchor, whole, (first + at).astype(np.uint64), (end + at).astype(np.uint64), places.astype(np.uint64)]))
    return np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.uint64)


class Suffixes:
    """Suffixes of ``data`` sorted by their first ``depth`` bytes (or words) or more (beyond the end: zeros).

    Ranks by the first 8 bytes (or the first word) give ranks by the first 24, and so on: three ranks of 21 bits make
    one sort key.
    """

    def __init__(self, data: np.ndarray, depth: int, starts: np.ndarray | None = None):
        self.data = data
        n = len(data)
        key, width = data, 1
        if data.dtype == np.uint8:
            padded = np.r_[data, np.zeros(8, np.uint8)]
            key, width = np.zeros(n, np.uint64), 8
            for i in range(8):
                key = key << np.uint64(8) | padded[i : n + i]
        self.levels = []
        while True:
            ordered, inverse = np.unique(key, return_inverse=True)
            times = 3 if len(ordered) < (1 << 21) - 1 else 2
            rank = np.r_[inverse.astype(np.uint32) + np.uint32(1), np.zeros(2 * width, np.uint32)]
            self.levels.append((width, rank))
            if width * 2 > depth:
                break
            key = rank[:n].astype(np.uint64)
            for k in range(1, times):
                key = key << np.uint64(21 if times == 3 else 32) | rank[k * width : n + k * width]
            width *= times
        starts = np.arange(n) if starts is None else starts
        width, rank = self.levels[-1]
        tail = np.minimum(starts + max(depth - width, 0), n)
        self.array = starts[np.lexsort((starts, rank[tail].astype(np.uint64) | rank[starts].astype(np.uint64) << np.uint64(32)))]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes, up to almost twice the last level."""
        n, out = len(self.data), np.zeros(len(a), np.int64)
        for k, (width, rank) in enumerate(reversed(self.levels)):
            for _ in range(1 if k == 0 else 2):
                i, j = np.minimum(a + out, n), np.minimum(b + out, n)
                out += width * ((rank[i] == rank[j]) & (rank[i] > 0))
        live = np.ones(len(a), bool)
        for _ in range(7):
            i, j = a + out, b + out
            live &= (i < n) & (j < n)
            live[live] = self.data[i[live]] == self.data[j[live]]
            out += live
        return out


def longest_previous(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest-previous-factor lengths, in suffix order.

    ``position`` holds the suffixes' places in suffix order, ``common[i]`` the common prefix of suffix i with the one
    before it. For each suffix the nearest with a smaller place above and below it in suffix order are found by
    jumping over those found already; the longer of their common prefixes is the longest match that begins earlier.
    """

    def nearest(place: np.ndarray, step: np.ndarray) -> np.ndarray:
        n = len(place)
        target, least = np.arange(n) - 1, step.copy()
        todo = np.flatnonzero(target >= 0)
        while True:
            todo = todo[target[todo] >= 0]
            todo = todo[place[target[todo]] > place[todo]]
            if not len(todo):
                break
            over = target[todo]
            least[todo] = np.minimum(least[todo], least[over])
            target[todo] = target[over]
        return np.where(target >= 0, least, 0)

    above = nearest(position, common)
    below = nearest(position[::-1], np.r_[0, common[:0:-1]])[::-1] if len(position) else above
    return np.maximum(above, below)


def repeated(data: np.ndarray, starts: np.ndarray, length: int, earlier_only: bool) -> np.ndarray:
    """Those ``starts`` (ascending) whose next ``length`` bytes also begin at another of them (or at one before).

    Only stretches whose hash repeats are sorted: the others can have no match of that length.
    """
    hashes = Hashes(data).of(starts, starts + length)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(starts), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    kept = starts[again]
    if not len(kept):
        return kept
    lo, hi = _spans(kept, length)
    base = np.r_[0, np.cumsum(hi - lo)[:-1]]
    shift = np.repeat(lo - base, np.diff(np.r_[np.searchsorted(kept, lo), len(kept)]))
    suffixes = Suffixes(np.concatenate([data[a:b] for a, b in zip(lo, hi, strict=True)]), length, kept - shift)
    sa = suffixes.array
    common = np.r_[0, suffixes.common(sa[1:], sa[:-1])]
    long = common >= length
    near = long | np.r_[long[1:], False]  # others have no match of this length
    sa, common = sa[near], np.where(long, common, 0)[near]
    found = longest_previous(sa, common) >= length
    if not earlier_only:
        found |= longest_previous(-sa, common) >= length
    return np.sort(kept[np.searchsorted(kept - shift, sa[found])])


def _spans(starts: np.ndarray, length: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) over sorted starts, for each owner apart."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + length
    if owner is not None:
        new[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)].astype(np.int64) - 1
    return starts[first], starts[last] + length


def _meet(length: int, earlier_only: bool, kind: np.dtype):
    """One bin: blocks (uid, doc_id, lo, bytes or words' hashes) to spans (uid, lo, hi) to remove."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "uid", "lo"])
        ids, lows, bodies = pdf["uid"].to_numpy(), pdf["lo"].to_numpy(), pdf["body"].tolist()
        pieces, owners, bases, at, end = [], [], [], 0, -1
        segments: list[list[int]] = []  # place in the buffer, uid, offset in the document, length
        for u, lo, body in zip(ids, lows, (np.frombuffer(b, kind) for b in bodies), strict=True):
            if segments and segments[-1][1] == u and lo <= end:  # overlaps the last one: its places count once
                body = body[end - lo :]
                segments[-1][3] += len(body)
            else:
                segments.append([at, u, lo, len(body)])
                end = lo
            pieces.append(body)
            at += len(body)
            end += len(body)
        data = np.concatenate(pieces)
        starts = np.concatenate([np.arange(s, s + n - length + 1) for s, _, _, n in segments])
        hit = repeated(data, starts, length, earlier_only)
        begins = np.array([s[0] for s in segments])
        if not len(hit):
            return pd.DataFrame({"uid": [], "lo": [], "hi": []})
        which = np.searchsorted(begins, hit, "right") - 1
        lo, hi = _spans(hit, length, which)
        of = which[np.searchsorted(hit, lo)]
        shift = (np.array([s[2] for s in segments]) - begins)[of]
        return pd.DataFrame({"uid": np.array([s[1] for s in segments])[of], "lo": lo + shift, "hi": hi + shift})

    return run


def _find(docs: DataFrame, length: int, gram: int, units: Callable[[str | None], np.ndarray]) -> DataFrame:
    """Blocks (anchor, block, uid, doc_id, lo, hi, n) of whole texts, or of their ranges ``lo`` to ``hi`` if ``docs`` has such."""
    names = ["anchor", "block", "uid", "doc_id", "lo", "hi", "n"]
    ranged = "lo" in docs.columns

    def find(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                uids, ids, made, owner = part.column(0).to_pylist(), part.column(1).to_pylist(), [], []
                ranges = zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True) if ranged else ((None, None) for _ in uids)
                for i, (x, (los, his)) in enumerate(zip(part.column(2).to_pylist(), ranges, strict=True)):
                    data = units(x)
                    for lo, hi in zip(los, his, strict=True) if ranged else [(0, len(data))]:
                        if hi - lo >= length:
                            made.append(blocks(data[lo:hi], length, gram))
                            made[-1][2:4] += np.uint64(lo)
                            owner.append(np.full(made[-1].shape[1], i))
                if made:
                    anchor, block, lo, hi, n = np.concatenate(made, axis=1).view(np.int64)
                    who = np.concatenate(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, block, np.array(uids)[who], np.array(ids)[who], lo, hi, n)], names=names)
        release()

    return docs.select("uid", "doc_id", "text", *(["lo", "hi"] if ranged else [])).mapInArrow(find, ", ".join(f"{n} long" for n in names))


def _ranges(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a uid with arrays of its ranges, as ints."""
    found = rows.groupBy("uid").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in columns])).alias("r"))
    return found.select("uid", *[F.col(f"r.{c}").alias(c) for c in columns])


def _with_texts(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The texts that have ranges, beside them. The ranges are sent to all tasks if their bytes allow it."""
    arrays = [c for c, kind in ranges.dtypes if kind.startswith("array")]
    n, held = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size(arrays[0])), F.lit(0))).first()
    small = 64 * n + (8 + 4 * held) * len(arrays) <= SENT_BYTES
    return docs.select("uid", "doc_id", "text").join(F.broadcast(ranges) if small else ranges, "uid")


def _cut_out(docs: DataFrame, ranges: DataFrame, units: Callable[[str | None], np.ndarray]) -> DataFrame:
    """(bin, uid, doc_id, lo, body): the bytes (or words' hashes) of each range."""
    names = ["bin", "uid", "doc_id", "lo", "body"]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for r in batch.slice(at, SLICE).to_pylist():
                    data = units(r["text"])
                    rows += [(b, r["uid"], r["doc_id"], lo, data[lo:hi].tobytes()) for b, lo, hi in zip(r["bin"], r["lo"], r["hi"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=names)

    return _with_texts(docs, ranges).mapInArrow(cut, "bin long, uid long, doc_id long, lo long, body binary")


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = False, units: Callable[[str | None], np.ndarray] = in_bytes) -> DataFrame:
    """(uid, lo, hi): arrays of the ranges to remove from each text, in bytes or other ``units``. ``docs`` has uid, doc_id
    (not null) and text."""
    cuts, todo, grams, kind = None, docs, gram_sizes(length), units("").dtype
    for gram in grams:
        every = materialize(_find(todo, length, gram, units), "suffix-blocks")
        again = every.groupBy("anchor").agg(F.sum("n").alias("places"), F.count("*").alias("rows"), (F.min("block") != F.max("block")).alias("mixed"), F.max("n").alias("most"))
        again = again.filter("places > 1").select("anchor", "rows", (F.col("mixed") | (F.col("most") > 1)).alias("mixed"))
        again = materialize(again, "suffix-anchors")
        found = materialize(skew_safe_left_join(every, again, ["anchor"], "rows").filter("rows is not null"), "suffix-again")
        # Equal blocks: all but the first, or all, are copies as a whole. The first of each kind stands for it.
        kinds = found.filter("mixed or rows > 1").groupBy("anchor", "block").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid", "lo", "hi")).alias("first"), F.first("mixed").alias("mixed"))
        kinds = materialize(kinds, "suffix-kinds")
        copies = skew_safe_left_join(found.select("anchor", "block", "uid", "lo", "hi"), kinds.filter("copies > 1"), ["anchor", "block"], "copies").filter("copies is not null")
        if keep_first:
            copies = copies.filter((F.col("uid") != F.col("first.uid")) | (F.col("lo") != F.col("first.lo")))
        made = copies.select("uid", "lo", "hi")
        # Kinds of anchors that have several kinds (or touch themselves) are compared; whole copies need no more, but
        # others may match parts of them.
        open_ = kinds.filter("mixed").select("anchor", "first.*")
        sizes = materialize(open_.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("hi") - F.col("lo")).alias("bytes")), "suffix-open")
        few = sizes if gram == grams[-1] else sizes.filter(F.col("kinds") <= MANY)
        total, wide = few.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
        if wide:
            bins = max(12, total * kind.itemsize // BIN_BYTES + 1)
            dealt = open_.join(sized_broadcast(few.select("anchor"), wide), "anchor", "left_semi").select("uid", "lo", "hi", F.pmod(F.xxhash64("anchor"), F.lit(bins)).alias("bin"))
            ranges = materialize(_ranges(dealt.distinct(), "bin", "lo", "hi"), "suffix-wanted")
            made = made.unionByName(_cut_out(docs, ranges, units).groupBy("bin").applyInPandas(_meet(length, keep_first, kind), "uid long, lo long, hi long"))
        cuts = made if cuts is None else cuts.unionByName(made)
        many = sizes.filter(F.col("kinds") > MANY).select("anchor") if gram < grams[-1] else None
        if many is None or not (n := many.count()):
            break
        todo = _with_texts(docs, materialize(_ranges(open_.join(sized_broadcast(many, n), "anchor", "left_semi"), "lo", "hi"), "suffix-longer"))
    return _ranges(cuts, "lo", "hi")


def _with_spans(docs: DataFrame, spans: DataFrame, uid: str, *names: str) -> DataFrame:
    """``docs`` with the arrays lo and hi of their spans, called ``names``. The spans are sent to all tasks if their bytes allow it."""
    n, held = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("lo")), F.lit(0))).first()
    spans = spans.select(F.col("uid").alias(uid), *[F.col(c).alias(name) for c, name in zip(("lo", "hi"), names, strict=True)])
    return docs.join(F.broadcast(spans) if 64 * n + 8 * held <= SENT_BYTES else spans, uid, "left")


def _covered(lo: str, hi: str) -> Column:
    """How much the union of some spans covers."""

    def add(so_far: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span[hi] - F.greatest(so_far["end"], span[lo]))
        return F.struct(F.greatest(so_far["end"], span[hi]).alias("end"), (so_far["n"] + more).alias("n"))

    spans = F.coalesce(F.array_sort(F.arrays_zip(lo, hi)), F.array())
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"].cast("long")


def drop_repeated_strings(docs: DataFrame, length: int = 400, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans (long).

    With ``words`` also n_repeated_words (long): how many words of the text lie under that many words in a row that also
    begin elsewhere, whatever their bytes and the white space between them. These words stay in kept.

    A byte is removed if it lies under ``length`` bytes of the input that also begin elsewhere, in the same document
    or another; with ``keep_first`` only if they begin earlier, by doc_id and place, so that the first copy stays.
    Matches may overlap themselves and never cross documents. n_spans counts maximal removed runs. A null text is
    empty, a null doc_id comes first, rows that repeat a doc_id are documents of their own (equal ones are copies of
    each other and lose the same bytes). An empty table gives an empty result. Other columns pass through, whatever
    they are called; those named like an output are replaced.
    """
    names = ["kept", "n_bytes", "n_removed", "n_spans"]
    counted = ["n_repeated_words"] if words else []
    uid, pair, lo, hi, first, last = fresh(docs.columns, "__uid", "__pair", "__lo", "__hi", "__first", "__last")
    marked = docs.withColumn(uid, F.xxhash64(col(doc_id), F.coalesce(col(text), F.lit(""))))
    texts = marked.select(F.col(uid).alias("uid"), sid(doc_id).alias("doc_id"), col(text).alias("text"))
    joined = _with_spans(marked, materialize(repeated_spans(texts, length, keep_first), "suffix-spans"), uid, lo, hi)
    joined = joined.withColumn(pair, F.struct(col(text).alias("text"), F.col(lo).alias("lo"), F.col(hi).alias("hi")))
    if words:
        spans = materialize(repeated_spans(texts, words, keep_first, in_words), "suffix-word-spans")
        joined = _with_spans(joined, spans, uid, first, last).withColumn(counted[0], _covered(first, last))

    def make():
        def one(row: dict) -> tuple[bytes, int, int, int]:
            data = (row["text"] or "").encode("utf-8", "surrogatepass")
            out, at, runs, end = [], 0, 0, -1
            for lo, hi in sorted(zip(row["lo"] or (), row["hi"] or (), strict=True)):
                if lo > end:
                    runs += 1
                    out.append(data[at:lo])
                at = end = max(end, hi)
            out.append(data[at:])
            kept = b"".join(out)
            return kept, len(data), len(data) - len(kept), runs

        return lambda rows: tuple(zip(*map(one, rows), strict=True)) or ([], [], [], [])

    out = [T.StructField(n, T.BinaryType() if n == "kept" else T.LongType()) for n in names]
    return map_text(joined.select(*map(col, others(docs.columns, *names, *counted)), *counted, pair), make, pair, out).drop(pair)
