"""Language-model scores: the cross-entropy difference of two n-gram models.

A target model and a background model are matched: same order, smoothing and one shared vocabulary, the words of the
whole corpus. The target counts come from chosen documents, the background counts from a sample of the others that has
as many characters; where there are fewer others, the target is the sample. Both grow with the corpus. A document of
either sample is left out of its own counts, so that it isn't told apart by having been counted. A document's score
is the mean over its words of background loss minus target loss, in nats: higher is more like the target.

Counts are exact but for equal 63-bit hashes. Texts are dealt into blocks; a block asks for the counts of its
different n-grams, each part of the hash range adds up what all blocks hold of it and answers each block, and the
answers meet the block's texts. So tables grow with the corpus, and memory only with a block and a part of the range.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW, col, fresh, materialize, others, release, sized_broadcast

#: Least number of words that the uniform distribution is over; the number of different words where that is larger.
VOCABULARY = 1 << 18
#: Smoothing: what a pair's word weighs beside its counts, and the share of the uniform distribution in that of words.
PAIR_PRIOR, UNIFORM = 2.0, 0.1
#: Steps in which the size of a sample is chosen.
SAMPLE_BINS = 4096
#: Roles of documents.
TARGET, BACKGROUND = 1, 2
#: Characters of a block of texts, and characters of the corpus for each part of the hash range: sizes of tasks.
BLOCK_CHARS, RANGE_CHARS = 1 << 22, 1 << 23

_words = re.compile(r"\w+|[^\w\s]").findall


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 or 1
        if len(self) < 300_000:
            self[word] = out
        return out


def word_ids(text: str | None, known: dict) -> np.ndarray:
    """0, which begins a text, then the 63-bit hashes of its words (runs of word characters, or single signs) in lower case."""
    words = _words((text or "").lower())
    out = np.zeros(len(words) + 1, np.int64)
    out[1:] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return out


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) & ~np.uint64(1)


def pair_ids(ids: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it: even, while words as such have odd keys."""
    return _mixed(ids[:-1], ids[1:].astype(np.uint64))


class _Block:
    """Different n-grams of some texts as sorted ``keys``, and for each word of the texts the places of its word, its context and its pair."""

    def __init__(self, texts: list[str | None], known: dict):
        ids = [word_ids(x, known) for x in texts]
        self.sizes = np.array([len(i) - 1 for i in ids])
        flat = np.concatenate(ids)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(self.sizes + 1) - self.sizes - 1] = False
        inside = inside[1:]
        words, at = np.unique(flat, return_inverse=True)
        pairs, pair = np.unique(pair_ids(flat)[inside], return_inverse=True)
        keys = np.concatenate([words.astype(np.uint64) * np.uint64(2) + np.uint64(1), _mixed(words, ~np.uint64(0)), pairs])
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.word, self.context, self.pair = place[at[1:][inside]], place[at[:-1][inside] + len(words)], place[pair + 2 * len(words)]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key occurs in the places of ``chosen`` words."""
        return sum(np.bincount(x[chosen], minlength=len(self.keys)) for x in (self.word, self.context, self.pair))

    def own(self, chosen: np.ndarray) -> list[np.ndarray]:
        """For the places of ``chosen`` words, how often their own text has their word, context and pair."""
        owner, out = np.repeat(np.arange(len(self.sizes)), self.sizes)[chosen], []
        for x in (self.word, self.context, self.pair):
            _, at, times = np.unique(owner * len(self.keys) + x[chosen], return_inverse=True, return_counts=True)
            out.append(times[at])
        return out


def _pack(values: np.ndarray) -> bytes:
    """Integers in as many bytes as the largest needs: that number, then all first bytes, all second bytes and so on."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes((width,)) + values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def counts(docs: DataFrame, ranges: int, text: str = "text", role: str = "role", block: str = "block") -> DataFrame:
    """Rows of block, range, background and target: counts in the texts whose role is BACKGROUND or TARGET, of the keys of
    the block in that of ``ranges`` parts of the hash range, in order of the keys. Of n_background, n_target (words of
    these texts) and n_distinct (different words of all texts) the sums over all rows count.
    """
    ask = "block long, range int, keys binary, n binary, t binary"
    known = _Ids()

    def requests(docs: pa.Table) -> pa.Table:
        own = _Block(docs.column("text").to_pylist(), known)
        roles = np.repeat(np.array(docs.column("role").to_pylist(), np.int64), own.sizes)
        n, t = (own.counts(roles == r).astype(np.uint64) for r in (BACKGROUND, TARGET))
        part = ((own.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        cuts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        steps = [np.diff(own.keys[c], prepend=np.uint64(0)) for c in cuts]
        columns = [[docs.column("block")[0].as_py()] * len(cuts), part[edges[:-1]], *[[_pack(x) for x in y] for y in (steps, [n[c] for c in cuts], [t[c] for c in cuts])]]
        release()
        return pa.table({k: pa.array(c, v) for k, c, v in zip(("block", "range", "keys", "n", "t"), columns, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)})

    def answers(asked: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k.as_py()), dtype=np.uint64) for k in asked.column("keys")]
        edges = np.cumsum([0, *map(len, keys)])
        different, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = [np.zeros(len(different), np.int64) for _ in range(2)]
        for total, name in zip(sums, ("n", "t"), strict=True):
            for k, x in enumerate(asked.column(name)):
                total[at[edges[k] : edges[k + 1]]] += _unpack(x.as_py()).astype(np.int64)  # a block has a key once
        words = (different & np.uint64(1)).astype(bool)
        once = [int(sums[0][words].sum()), int(sums[1][words].sum()), int((words & (different > 1)).sum())]  # 1: the beginning of a text
        rest = [0] * (asked.num_rows - 1)
        made = [pa.array([_pack(total[at[a:b]]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary()) for total in sums]
        release()
        return pa.table([asked.column("block"), asked.column("range"), *made, *[pa.array([x, *rest], pa.int64()) for x in once]], ["block", "range", "background", "target", "n_background", "n_target", "n_distinct"])

    asked = docs.select(col(block).alias("block"), col(text).alias("text"), col(role).alias("role")).groupBy("block").applyInArrow(requests, ask)
    return asked.groupBy("range").applyInArrow(answers, "block long, range int, background binary, target binary, n_background long, n_target long, n_distinct long")


def score(docs: DataFrame, models: DataFrame, text: str = "text", role: str = "role", block: str = "block") -> DataFrame:
    """``docs`` without ``block`` and ``role``, with n_words (long), target_loss, background_loss and score (double;
    background minus target loss). ``models``: what ``counts`` made of the same texts in the same blocks, as a written table.

    Losses are means over the words of the whole text; a text without words (null, empty) has losses and score 0.
    Other columns pass through, those named like an output are replaced.
    """
    sums = models.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_background", "n_target", "n_distinct")]).first()
    totals, vocabulary = {"background": sums[0], "target": sums[1]}, max(VOCABULARY, sums[2])
    out = [T.StructField("n_words", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score")]]
    kept = others(docs.columns, block, role, *[f.name for f in out])
    numbered = [f"c{i}" for i in range(len(kept) + len(out))]  # names with dots can't go through cogroup
    known = _Ids()

    def losses(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own, answers = _Block(docs.column("text").to_pylist(), known), answers.sort_by("range")
        owner, means = np.repeat(np.arange(len(own.sizes)), own.sizes), []
        roles = np.array(docs.column("role").to_pylist(), np.int64)
        for name, number in (("target", TARGET), ("background", BACKGROUND)):
            n = np.concatenate([_unpack(x.as_py()).astype(np.int64) for x in answers.column(name)])
            word, context, pair, total = n[own.word], n[own.context], n[own.pair], np.full(len(owner), totals[name])
            if len(mine := np.flatnonzero(roles[owner] == number)):  # leave the text itself out
                for x, times in zip((word, context, pair), own.own(mine), strict=True):
                    x[mine] -= times
                total[mine] -= own.sizes[owner[mine]]
            p = np.where(total > 0, (1 - UNIFORM) * word / np.maximum(total, 1) + UNIFORM / vocabulary, 1 / vocabulary)
            loss = -np.log((pair + PAIR_PRIOR * p) / (context + PAIR_PRIOR))
            means.append(np.bincount(owner, loss, len(own.sizes)) / np.maximum(own.sizes, 1))
        release()
        made = [own.sizes, *means, means[1] - means[0]]
        return pa.table([*[docs.column(c) for c in numbered[: len(kept)]], *[pa.array(x, ARROW[f.dataType.simpleString()]) for x, f in zip(made, out, strict=True)]], numbered)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(numbered, [*[docs.schema[c] for c in kept], *out], strict=True)])
    read = docs.select(col(block).alias("block"), col(text).alias("text"), col(role).alias("role"), *[col(c).alias(n) for c, n in zip(kept, numbered, strict=False)])
    scored = read.groupBy("block").cogroup(models.select("block", "range", "background", "target").groupBy("block")).applyInArrow(losses, schema)
    return scored.toDF(*kept, *[f.name for f in out])


def with_roles(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", role: str = "role") -> DataFrame:
    """``docs`` with ``role``: TARGET for documents that any label row marks 1, BACKGROUND for a sample of the others, by
    the hash of id and text, that comes nearest to as many characters in SAMPLE_BINS steps; 0 for the rest. If the
    others have fewer characters, all of them are the background and the target is a sample in the same way. Null ids
    are never the target."""
    good, side, place = fresh(docs.columns, "__good", "__side", "__place")
    marks = labels.filter(col(label) == 1).select(col(doc_id).cast("long").alias(good)).distinct()
    docs = docs.join(sized_broadcast(marks), col(doc_id).cast("long") == F.col(good), "left")
    docs = docs.withColumn(side, F.when(F.col(good).isNotNull(), TARGET).otherwise(BACKGROUND)).withColumn(place, F.pmod(F.xxhash64(F.lit("sample"), col(doc_id), col(text)), F.lit(SAMPLE_BINS)))
    sizes = np.zeros((3, SAMPLE_BINS), np.int64)
    for k, i, n in docs.groupBy(side, place).agg(F.coalesce(F.sum(F.length(col(text))), F.lit(0))).collect():  # 2 * SAMPLE_BINS rows at most
        sizes[k, i] = n
    wanted = min(sizes[TARGET].sum(), sizes[BACKGROUND].sum())
    cuts = {k: int(np.abs(np.r_[0, np.cumsum(sizes[k])] - wanted).argmin()) if sizes[k].sum() > wanted else SAMPLE_BINS for k in (TARGET, BACKGROUND)}
    inside = F.col(place) < F.when(F.col(side) == TARGET, cuts[TARGET]).otherwise(cuts[BACKGROUND])
    return docs.withColumn(role, F.when(inside, F.col(side)).otherwise(0)).drop(good, side, place)


def score_by_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Scores with the documents that any label row marks 1 as the target (see ``with_roles`` and ``score``).

    Without any such document both models are uniform and all scores 0. Rows are documents of their own, those that
    repeat an id and a text too: each is left out of its own counts, its copies stay. An empty table gives an empty
    result. Other columns pass through, whatever they are called; those named like an output are replaced.
    """
    chars = docs.agg(F.sum(F.length(col(text)))).first()[0] or 0
    role, block = fresh(docs.columns, "__role", "__deal")
    dealt = F.pmod(F.xxhash64(col(doc_id), col(text)), F.lit(chars // BLOCK_CHARS + 1))
    marked = with_roles(docs, labels, doc_id, text, label, role).withColumn(block, dealt)
    models = materialize(counts(marked, chars // RANGE_CHARS + 1, text, role, block), "models")
    return score(marked, models, text, role, block)
