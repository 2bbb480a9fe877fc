"""Best-fit packing of tokenized documents into sequences, by best-two-fit.

A sequence is filled greedily with the longest pieces that fit. Then its smallest piece is replaced by two that are not
packed yet, if two fit the gap that this opens more tightly. What the method does depends only on which lengths are
left, and there are no more of these than tokens in a sequence: the driver sees how many pieces have each length, and
one step fills all the sequences that would come out alike. Its plan says which pieces of a length, by their number,
go to which sequences; Spark numbers the pieces of each length, hot ones in many ranges, and joins the plan.
"""

from __future__ import annotations

import os
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, col, fresh, materialize, others, release

#: Stretches of text whose ids a worker remembers, and their greatest length. Others are encoded each time.
CACHE, CACHE_CHARS = 400_000, 40
#: Characters of documents that are encoded together (a longer document is alone).
CHARS = 1 << 22
#: Pieces of one length that one task numbers on average.
RANGE_ROWS = 2_000

PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]


#: Texts with white space (what ``str.isspace`` holds of) side by side or at the beginning, as Arrow's patterns write it.
_SPACES = r"(\A|[{0}])[{0}]".replace("{0}", r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
#: The end of a word: Latin letters and digits, which are the same in all versions of Unicode.
_WORD_END = r"[A-Za-z0-9À-ÖØ-öø-ɏ]\z"
#: Safe places of texts that have such: at single spaces and before single line breaks.
_SAFE = re.compile(r"(?<!\s)(?: (?!\s)|(?=\n(?!\s)))")


class Tokens:
    """Ids of texts as the tokenizer gives them, little-endian unsigned 32-bit integers.

    The library takes as long for a word that it has seen as for a new one. So texts are cut where a space or a line
    break stands alone (there a match of the byte-level pattern begins, whatever surrounds it), Arrow finds the different
    stretches of many texts, and only those that are not remembered are encoded, together. A stretch that begins with a
    line break stands for itself, any other for a space and itself. Punctuation at the end of a stretch is a match of its
    own, so it is encoded apart and the word before it is the same with and without.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.line = np.array([self.tokenizer.id_to_token(i) == "Ċ" for i in range(size)])
        self.known: dict[str, bytes] = {}
        #: Whether spaces, line breaks and punctuation begin matches, which holds of byte-level tokenizers that split by
        #: their pattern.
        self.cuts = self.line.sum() == 1 and all(self._whole("".join(x)) == b"".join(map(self._whole, x)) for a in "a1.'é" for x in [*[(a, s + b) for b in "a1.'é" for s in (" ", "\n")], *[(a, p) for p in string.punctuation if a.isalnum()], ("\n", a)])

    def _ids(self, text: str) -> np.ndarray:
        # The fast way gives the same ids and leaves out where they stand in the text.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _together(self, text: str, first: np.ndarray) -> list[bytes]:
        """Ids of the stretches of ``text``: each starts with one of the tokens ``first`` and has no other."""
        ids = self._ids(text)
        starts = (np.flatnonzero(first[ids]) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]

    def _learn(self, new: list[str]) -> None:
        lines, words, odd = [], [], []
        for w in new:
            own = w[1:] if w[:1] == "\n" else w
            plain = own and not own[0].isspace() and not own[-1].isspace() and " " not in own and (own is w or "\n" not in own)
            (odd if not plain else words if own is w else lines).append(w)
        if words:
            self.known.update(zip(words, self._together(" " + " ".join(words), self.spaced), strict=True))
        if lines:
            self.known.update(zip(lines, self._together("".join(lines), self.line), strict=True))
        self.known.update((w, self._whole(w if w[:1] == "\n" else " " + w)) for w in odd)

    def _stretches(self, keys: pa.Array) -> pa.Array:
        """Ids of stretches."""
        known, trimmed = self.known, pc.utf8_rtrim(keys, string.punctuation)
        ends = pc.match_substring_regex(trimmed, _WORD_END)
        sizes = np.where(ends, pc.subtract(pc.binary_length(keys), pc.binary_length(trimmed)), 0)
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset :][: len(keys) + 1]
        upto = np.cumsum(sizes)
        own = np.repeat(offsets[1:] - upto, sizes) + np.arange(sizes.sum())
        marks = pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(np.r_[0, upto].astype(np.int32)), pa.py_buffer(np.frombuffer(keys.buffers()[2] or b"", np.uint8)[own])]).dictionary_encode()
        coded = pc.if_else(ends, trimmed, keys).dictionary_encode()
        words, kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), ["\n" + m for m in marks.dictionary.to_pylist()]
        before, new = len(known), [w for w in dict.fromkeys([*kinds, *words]) if w not in known]
        self._learn(new)
        parts = [pa.array([known[w] for w in words], pa.binary()).take(coded.indices), pa.array([known[k][4:] for k in kinds], pa.binary()).take(marks.indices)]
        for w in new[max(0, CACHE - before) :] if len(known) > CACHE else [w for w in new if len(w) > CACHE_CHARS]:
            del known[w]
        return pc.binary_join_element_wise(*parts, b"")

    def packed(self, texts: pa.Array, tail: bytes = b"") -> tuple[pa.Buffer | None, np.ndarray]:
        """The ids of all texts (no nulls), each followed by ``tail``, and where they begin, with the end of the last one."""
        wide = np.asarray(pc.match_substring_regex(texts, _SPACES)) if self.cuts else np.ones(len(texts), bool)
        # Each text gives "", the line break with its first stretch, and its other stretches.
        lines = pc.binary_join_element_wise(pa.scalar(""), texts.filter(pa.array(~wide)), "\n")
        words = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        odd = [_SAFE.split(t) if self.cuts else [t] for t in texts.filter(pa.array(wide)).to_pylist()]
        if odd:
            words = pa.concat_arrays([words, pa.array([["", "\n", *x[1:]] for x in odd], words.type)])
            words = words.take(pa.array(np.argsort(np.r_[np.flatnonzero(~wide), np.flatnonzero(wide)])))
        coded = words.flatten().dictionary_encode()
        ids, codes = self._stretches(coded.dictionary), np.append(coded.indices, 0)
        starts = np.r_[0, np.cumsum(pc.list_value_length(words))]
        firsts = [x[4:] for x in ids.take(pa.array(codes[starts[:-1] + 1])).to_pylist()]
        for i, x in zip(np.flatnonzero(wide).tolist(), odd, strict=True):
            firsts[i] = self._whole(x[0])  # may begin with white space, which a line break before it would change
        # What stands for "" before a text ends the one before it.
        codes[starts] = len(ids)
        codes[starts[:-1] + 1] = len(ids) + 1 + np.arange(len(texts))
        stream = pa.concat_arrays([ids, pa.array([tail, *firsts], pa.binary())]).take(pa.array(codes))
        return stream.buffers()[2], np.frombuffer(stream.buffers()[1], np.int32)[starts + 1]

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = self.packed(pa.array(texts, pa.string()))
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_TOKENS: dict[str, Tokens] = {}
KEPT["packing"] = _TOKENS.clear


def token_pieces(df: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, text: str = "text") -> DataFrame:
    """The pieces of each document: all columns but ``text``, and piece (from 0), start, length, ids (packed little-endian
    unsigned 32-bit integers).

    ``tokenizer``: path of a definition on the driver (under 2 MB, it travels with the tasks). A document's ids end with
    ``end``; a null text is empty and has this id alone. Documents of more than ``size`` ids are cut, and only the first
    piece is shorter then. Rows are independent, repeated ones give repeated pieces, an empty table gives none.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    tail = np.array([end], "<u4").tobytes()
    text = next(c for c in df.columns if c.lower() == text.lower())
    kept = others(df.columns, text, *[f.name for f in PIECE])
    names = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([*[T.StructField(n, df.schema[c].dataType) for n, c in zip(names, kept, strict=True)], *PIECE])

    def cut(batch: pa.RecordBatch, coder: Tokens) -> pa.RecordBatch:
        data, at = coder.packed(batch.column(len(kept)).fill_null(""), tail)
        n = np.diff(at).astype(np.int64) // 4
        counts, first = (n - 1) // size + 1, (n - 1) % size + 1
        rows = np.repeat(np.arange(len(n)), counts)
        numbers = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.where(numbers, first[rows] + (numbers - 1) * size, 0)
        lengths = np.where(numbers, size, first[rows])
        ends = np.append(at[rows] + 4 * starts, at[-1]).astype(np.int32)  # pieces follow each other without gaps
        pieces = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), data])
        taken = batch.select(list(range(len(kept)))).take(pa.array(rows, pa.int64()))
        made = [pa.array(numbers.astype(np.int32)), pa.array(starts), pa.array(lengths), pieces]
        return pa.RecordBatch.from_arrays([*taken.columns, *made], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("packing")
        coder = _TOKENS.get(definition)
        if coder is None:
            _TOKENS.clear()
            coder = _TOKENS[definition] = Tokens(definition)
        for batch in batches:
            sizes = np.cumsum(batch.column(len(kept) + 1).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARS, "right")))
                yield cut(batch.slice(at, stop - at), coder)
                at = stop
        del coder
        release("packing")

    read = df.select(*[col(c).alias(n) for c, n in zip(kept, names, strict=True)], col(text).alias("t"), F.coalesce(F.length(col(text)), F.lit(0)).alias("n"))
    return read.mapInArrow(run, schema).toDF(*kept, *schema.names[len(kept) :])


class _Lengths:
    """How many pieces of each length are left to pack."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def take(self, length: int, count: int) -> None:
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            del self.order[bisect_right(self.order, length) - 1]

    def greedy(self, size: int) -> Counter:
        """The longest that fits, again and again."""
        held, at = Counter(), len(self.order)
        while (at := bisect_right(self.order, size, 0, at)) > 0:
            length = self.order[at - 1]
            many = min(self.left[length], size // length)
            held[length] = many
            size -= many * length
            at -= 1
        return held

    def best_two(self, gap: int, more_than: int, held: Counter) -> tuple[int, int] | None:
        """Two lengths that are left beside ``held`` with the greatest sum up to ``gap`` and above ``more_than``; on ties
        those with the longest one, which is the hardest to place later."""
        spare = [n for n in self.order[: bisect_right(self.order, gap)] if self.left[n] > held.get(n, 0)]
        low, high, best, found = 0, len(spare) - 1, more_than, None
        while low <= high:
            small, large = spare[low], spare[high]
            if small + large > gap:
                high -= 1
            elif low == high and self.left[small] - held.get(small, 0) < 2:
                break
            else:
                if small + large > best:
                    best, found = small + large, (small, large)
                low += 1
        return found


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences), in the order of packing. ``counts``: pieces by length."""
    lengths, out = _Lengths(counts), []
    while lengths.order:
        held = lengths.greedy(size)
        smallest = min(held)
        gap = size - sum(n * c for n, c in held.items())
        if gap:
            rest = held - Counter([smallest])
            two = lengths.best_two(gap + smallest, smallest, held)
            if two:
                held = rest + Counter(two)
        many = min(lengths.left[n] // c for n, c in held.items())
        for n, c in held.items():
            lengths.take(n, c * many)
        out.append((sorted(held.elements(), reverse=True), many))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): pieces ``first`` to ``last`` of a length (by their number) go to the
    sequences from ``sequence`` on, each at ``offset``."""
    used, sequence = Counter(), 0
    for lengths, many in patterns:
        at = 0
        for n in lengths:
            yield n, used[n], used[n] + many - 1, sequence, at
            used[n] += many
            at += n
        sequence += many


def numbered(pieces: DataFrame, row: str, length: str, number: str) -> DataFrame:
    """``pieces`` (a written table with different values in ``row``) with ``number``: from 0 within each length."""
    rows = pieces.count()
    (part, ahead) = fresh([*pieces.columns, number], "__part", "__ahead")
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64(col(row)), F.lit(max(1, min(1 << 16, rows // RANGE_ROWS)))))
    sizes = dealt.groupBy(col(length), part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    place = F.row_number().over(Window.partitionBy(length, part).orderBy(row)) - 1
    return dealt.withColumn(number, place).join(sizes, [length, part]).withColumn(number, col(number) + col(ahead)).drop(part, ahead)


def pack(pieces: DataFrame, size: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset``: sequences of at most ``size`` tokens, each filled from 0 on
    without gaps. Sequences are as few as best-two-fit makes them.

    Every row must have a length from 1 to ``size``; others are an error. Rows may repeat, all columns pass (those called
    like an output are replaced), an empty table gives an empty one. The driver holds ``size`` counts and a plan whose
    size depends on ``size`` only. The rows are written once, so that a lost task numbers them alike.
    """
    kept = others(pieces.columns, "sequence_id", "offset")
    n, row, number, first, last, base, at = fresh(kept, "__length", "__row", "__number", "__first", "__last", "__base", "__at")
    own = pieces.select(*map(col, kept), col(length).cast("long").alias(n)).withColumn(row, F.monotonically_increasing_id())
    own = materialize(own, "packing-pieces")
    counts = {r[0]: r[1] for r in own.filter(col(n).between(1, size)).groupBy(n).count().collect()}
    if own.filter(~F.coalesce(col(n).between(1, size), F.lit(False))).limit(1).count():
        raise ValueError(f"a piece has no length from 1 to {size}")
    plan = own.sparkSession.createDataFrame(list(slots(best_two_fit(counts, size))), f"`{n}` long, `{first}` long, `{last}` long, `{base}` long, `{at}` long")
    placed = numbered(own, row, n, number).join(F.broadcast(plan), n).filter(col(number).between(col(first), col(last)))
    return placed.select(*map(col, kept), (col(base) + col(number) - col(first)).alias("sequence_id"), col(at).alias("offset"))


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from rows with sequence_id, offset and ``ids``. A
    sequence has a bounded number of tokens, and so of rows."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("offset"), col(ids).alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    out = packed.groupBy("sequence_id").agg(joined.alias("ids"))
    return out.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")
