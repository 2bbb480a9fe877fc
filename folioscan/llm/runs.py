"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Every block of 2^k words gets a name, equal for equal blocks, made from the names of its two halves; blocks that occur
once get a name of their own and are not looked at again. Two places have a common extension of the length that
comparing names on descending levels adds up to. A run with period p of at least 2p words covers two neighbours of the
grid 0, p, 2p, ..., so extending each pair of neighbours to both sides finds all runs. One side extends by half of what
is missing at least, so one comparison of names each side rules out nearly all pairs, and whole periods where a
document repeats no block that long.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW, col, map_text

#: Words of documents that are looked at together (a longer document is alone), and grid pairs at once.
WORDS, PAIRS = 1 << 17, 1 << 19

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def block_names(words: np.ndarray) -> np.ndarray:
    """Names (level x place) of the blocks of 2^level words at each place: equal and not negative for equal blocks, a
    negative one of its own for a block that occurs once. ``words`` are small integers. Levels end where no block repeats."""
    own = -1 - np.arange(len(words), dtype=np.int32)
    level, levels, size = np.where(np.bincount(words)[words] > 1, words, own).astype(np.int32), [], 1
    while (level >= 0).any():
        levels.append(level)
        again = np.flatnonzero((level[:-size] >= 0) & (level[size:] >= 0)) if size < len(level) else own[:0]
        pairs = level[again].astype(np.int64) << 32 | level[again + size]
        order = np.argsort(pairs)
        pairs = pairs[order]
        name = np.cumsum(np.concatenate([[False], pairs[1:] != pairs[:-1]])[: len(pairs)])
        many = np.bincount(name, minlength=1)[name] > 1 if len(name) else np.zeros(0, bool)
        level = own.copy()
        level[again[order[many]]] = name[many]
        size *= 2
    return np.array(levels, np.int32).reshape(len(levels), len(words))


def _extended(names: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from ``left`` on equal those from ``right`` on, and how many before the two."""
    after, before = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for k in range(len(names) - 1, -1, -1):
        level = names[k]
        after += (level[left + after] == level[right + after]).astype(np.int64) << k
        at = left - before - (1 << k)
        same = (at >= 0) & (level[np.maximum(at, 0)] == level[np.maximum(right - before - (1 << k), 0)])
        before += same.astype(np.int64) << k
    return after, before


def _first_spans(spans: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) with one start and end, that with the smallest period, in order."""
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    return spans[np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])[: len(spans)]]


def find_spans(names: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """All runs as rows (start, end, period) in the order of places. Texts of ``sizes`` words begin at ``starts``; a word
    that occurs nowhere else stands before the first and after each."""
    out = [np.zeros((0, 3), np.int64)]
    if not len(names):
        return out[0]
    # A text needs no period of which half is longer than the blocks that it repeats.
    top = np.zeros(len(sizes), np.int64)
    for level in names:
        top += np.logical_or.reduceat(level >= 0, starts)  # a text's last place counts the word after it, which is alone
    most = np.where(sizes >= least, np.minimum(sizes // 2, np.int64(2) << top), 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    half = (np.maximum(period, least - period) + 1) // 2
    level = np.frexp(half.astype(float))[1] - 1  # the largest with 2^level <= half
    live = level < top[text]
    text, period, level = text[live], period[live], level[live]
    pairs = (sizes[text] - 1) // period
    ends, at = np.cumsum(pairs), 0
    while at < len(pairs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = slice(at, stop)
        count = pairs[some]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p, k = np.repeat(period[some], count), np.repeat(level[some], count)
        left = np.repeat(starts[text[some]], count) + step * p
        back = left - (np.int64(1) << k)
        near = (names[k, left] == names[k, left + p]) | (back >= 0) & (names[k, np.maximum(back, 0)] == names[k, np.maximum(back + p, 0)])
        left, p = left[near], p[near]
        after, before = _extended(names, left, left + p)
        run = (after + before >= p) & (after + before + p >= least)
        out.append(_first_spans(np.stack([left - before, left + p + after, p], axis=1)[run]))
        at = stop
    return _first_spans(np.concatenate(out))


def runs_of_texts(texts: Sequence[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text (a list of words), by start, then period."""
    codes, starts, n, at = [np.zeros(1, np.int64)], [], 1, 1
    for words in texts:
        known: dict[bytes, int] = {}  # each text has its own numbers, so that texts don't repeat each other
        number = known.setdefault
        starts.append(at)
        codes.append(np.fromiter((number(w, len(known)) for w in words), np.int64, len(words)) + n)
        n += len(known)
        codes.append(np.array([n]))
        n, at = n + 1, at + len(words) + 1
    starts, sizes = np.array(starts, np.int64), np.array([len(t) for t in texts], np.int64)
    spans = find_spans(block_names(np.concatenate(codes)), starts, sizes, least)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 0]))]
    owner = np.searchsorted(starts, spans[:, 0], "right") - 1
    spans[:, 1] -= spans[:, 0]
    spans[:, 0] -= starts[owner]
    return np.split(spans, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else []


def collapsed_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by single spaces, less those that a run contains after its first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = list(compress(words, np.cumsum(depth[:-1]) == 0))
    return b" ".join(words)


def find_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Append ``n_words``, ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed``.

    Words are runs of characters that are not white space. A run is a longest stretch with its smallest period, of at
    least ``least`` words and two periods. A null or empty text has no words, no runs and an empty ``collapsed``. Rows are
    independent: repeated rows give repeated results, an empty table an empty one. Columns called like an output are
    replaced, all others pass. Memory goes with the longest text: a name for each word and level, four bytes each.
    """

    def make():
        def apply(rows: list) -> list:
            words = [(t or b"").split() for t in rows]  # bytes.split() knows just these six characters
            found: list[np.ndarray] = []
            at, held = 0, 0
            for i, w in enumerate(words):
                held += len(w)
                if held >= WORDS or i == len(words) - 1:
                    found += runs_of_texts(words[at : i + 1], least)
                    at, held = i + 1, 0
            every = np.concatenate([np.zeros((0, 3), np.int64), *found])
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(ARROW[RUN.simpleString()]))
            return [[len(w) for w in words], pa.ListArray.from_arrays(pa.array(offsets), parts), [collapsed_words(w, f) for w, f in zip(words, found, strict=True)]]

        return apply

    outputs = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())]
    # The bytes come in under an output's name, so that they don't go back.
    made = map_text(df.withColumn("collapsed", col(text).cast("binary")), make, "collapsed", outputs)
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: str = "runs") -> Column:
    """Column: the run with the greatest length, on ties the first start, then the smallest period; null without runs."""
    by_size = F.transform(runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(by_size)


def runs_text(runs: str = "runs") -> Column:
    """Column: a line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
