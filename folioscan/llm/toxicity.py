"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows, for its hash and for that of its first letters, so inflected forms share
one. Filters of several widths run over the whole text; the maximum of each filter over all positions feeds a logistic
layer. Scoring folds the embeddings into the filters beforehand, so a
text costs one table row a word and filter offset. Thresholds for the accept/reject decision are calibrated by
language on all labelled rows that training did not see, counted by score in Spark; the score itself knows only the text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_text, others, sized_broadcast

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
#: Letters of a word's beginning, and its buckets.
STEM, STEMS = 4, 1 << 13
PAD = max(WIDTHS)
#: Labelled rows that a model is fitted on, at most, for each label: those with the smallest hash of their doc_id.
MOST_POSITIVE, MOST_NEGATIVE = 2000, 4000
#: Characters of their whole texts together, at most; texts that don't fit are left to calibration.
MOST_CHARS = 1 << 25
#: Share of these, by the same hash, that training leaves out. Thresholds are calibrated on all rows it didn't use.
CALIBRATION = 0.2
#: Positive rows that the common threshold weighs beside a language's own, and that 0.5 weighs beside the common one.
PRIOR = 15.0
#: Width in log odds of the bins that scores are counted in for that, and the least score (and distance from 1) there.
BIN, LEAST_SCORE = 0.05, 1e-9
CHUNK = 1 << 15
#: Weight decay of the output layer.
DECAY = 1e-5

_words = re.compile(r"\w+").findall


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        whole, stem = (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in (word, word[:STEM]))
        out = (1 + whole % (BUCKETS - 1)) * STEMS + 1 + stem % (STEMS - 1)
        if len(self) < 200_000:
            self[word] = out
        return out


def hashed(text: str | None, known: dict | None = None) -> list[int]:
    """Both buckets of each word (run of word characters, lower case) of the text, as one number; 0 pads."""
    known = _Buckets() if known is None else known
    return list(map(known.__getitem__, _words((text or "").lower())))


@dataclass
class Model:
    embed: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each width and offset: what a word and its beginning add to the filters."""
        return [[tuple((e @ w[o]).astype(np.float32) for e in (self.embed, self.stems)) for o in range(len(w))] for w in self.filters]

    def score(self, docs: list[list[int]], tables: list | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        tables = tables or self.tables()
        pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        ids, edges, owners, held = [], [], [], 0

        def flush() -> None:
            nonlocal ids, edges, owners, held
            if not ids:
                return
            flat = np.concatenate([*ids, np.zeros(PAD, np.int32)])
            n, words, begins = len(flat) - PAD + 1, flat // STEMS, flat % STEMS
            for k, row in enumerate(tables):
                found = row[0][0][words[:n]]
                found += row[0][1][begins[:n]]
                for o in range(1, len(row)):
                    found += row[o][0][words[o : o + n]]
                    found += row[o][1][begins[o : o + n]]
                best = np.maximum.reduceat(found, edges, axis=0)[::2]
                part = pooled[:, k * FILTERS : (k + 1) * FILTERS]
                np.maximum.at(part, owners, best)
            ids, edges, owners, held = [], [], [], 0

        for i, doc in enumerate(docs):
            padded = np.array([*doc, *[0] * PAD], np.int32)
            for at in range(0, max(1, len(doc)), CHUNK):  # parts of a long text overlap by PAD words
                ids.append(padded[at : at + CHUNK + PAD])
                edges += [held, held + max(1, len(ids[-1]) - PAD)]  # windows that begin in the padding don't count
                owners.append(i)
                held += len(ids[-1])
            if held >= CHUNK:
                flush()
        flush()
        hidden = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))


def gradients(model: Model, docs: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Gradients of the mean logistic loss (with a little weight decay on the output layer): of filters, bias and output,
    of the output's bias, and for the words (as numbers) that the pooled places read, of their embeddings."""
    batch, size = len(docs), len(model.bias)
    padded = [np.concatenate([d, np.zeros(PAD, np.int64)]) for d in docs]
    starts = np.cumsum([0, *map(len, padded)])
    flat = np.concatenate([*padded, np.zeros(PAD, np.int64)])
    n, x = starts[-1], model.embed[flat // STEMS] + model.stems[flat % STEMS]
    pooled, where = np.empty((batch, size)), np.empty((batch, size), np.int64)
    for k, w in enumerate(model.filters):
        found = sum(x[o : o + n] @ w[o] for o in range(len(w)))
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for i in range(batch):
            lo, hi = starts[i], max(starts[i] + 1, starts[i + 1] - PAD)
            at = found[lo:hi].argmax(0)
            where[i, cols], pooled[i, cols] = lo + at, found[lo + at, np.arange(FILTERS)]
    hidden = np.maximum(pooled + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
    error = (p - y) / batch
    back = np.outer(error, model.out) * (hidden > 0)
    grads, rows, values = [], [], []
    for k, w in enumerate(model.filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g, grad = back[:, cols], np.empty_like(w)
        for o in range(len(w)):
            at = where[:, cols] + o
            grad[o] = np.einsum("bfd,bf->df", x[at], g)
            rows.append(flat[at].ravel())
            values.append((g[:, :, None] * w[o].T[None]).reshape(-1, DIM))
        grads.append(grad)
    return [*grads, back.sum(0), hidden.T @ error + DECAY * model.out], float(error.sum()), np.concatenate(rows), np.concatenate(values)


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 1, steps: int = 700, batch: int = 32, rate: float = 0.01) -> Model:
    """Logistic loss, Adam on filters and output, AdaGrad on the embedding rows that a step touches."""
    rng = np.random.default_rng(seed)
    embed, stems = rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.05, (STEMS, DIM))
    embed[0] = stems[0] = 0
    filters = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)) for w in WIDTHS]
    size = len(WIDTHS) * FILTERS
    model = Model(embed, stems, filters, np.zeros(size), rng.normal(0, 0.1, size), 0.0)
    if len(labels) == 0 or labels.min() == labels.max():
        model.constant = float(labels[0]) if len(labels) else 0.0
        return model
    dense = [*filters, model.bias, model.out]
    first, second = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    squares, b_first, b_second = (np.full(BUCKETS, 1e-3), np.full(STEMS, 1e-3)), 0.0, 0.0
    positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    steps = max(steps, 6 * len(docs) // batch)
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(positive, batch // 4), rng.choice(negative, batch - batch // 4)])
        grads, g, rows, values = gradients(model, [docs[i] for i in chosen], labels[chosen])
        for x, d, m, v in zip(dense, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b_first, b_second = b_first + 0.1 * (g - b_first), b_second + 0.01 * (g * g - b_second)
        model.out_bias -= rate * (b_first / (1 - 0.9**step)) / ((b_second / (1 - 0.99**step)) ** 0.5 + 1e-8)
        for table, sums, ids in ((embed, squares[0], rows // STEMS), (stems, squares[1], rows % STEMS)):
            touched, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros((len(touched), DIM))
            np.add.at(total, inverse, values)
            sums[touched] += (total**2).mean(1)
            table[touched] -= 0.1 * total / np.sqrt(sums[touched])[:, None]
            table[0] = 0
    return model


def best_cut(bins: np.ndarray, positive: np.ndarray, rows: np.ndarray) -> float:
    """The log odds with the highest F1 as a cut, halfway between two bins; 0 if there is no positive row."""
    if not positive.sum():
        return 0.0
    order = np.argsort(-bins)
    bins, hits = bins[order], np.cumsum(positive[order])
    at = int((2 * hits / (np.cumsum(rows[order]) + hits[-1])).argmax())
    return float(BIN * ((bins[at] + bins[at + 1] + 1) / 2 if at + 1 < len(bins) else bins[at] + 0.5) - (0.5 if at + 1 == len(bins) else 0))


def score_counts(rows: DataFrame, model: Model) -> list[tuple[str | None, int, int, int]]:
    """Language, bin of the score, positive rows and rows of each bin of each language, of _id, _label, _text, _lang.
    Of rows with the same _id the one with the highest score counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        buckets, tables = _Buckets(), shared.value.tables()
        return lambda texts: [shared.value.score([hashed(x, buckets) for x in texts], tables).astype(float)]

    scored = map_text(rows, make, "_text", [T.StructField("_score", T.DoubleType())])
    once = scored.groupBy("_id").agg(F.max(F.struct("_score", "_lang", "_label")).alias("r")).select("r.*")
    score = F.greatest(F.least("_score", F.lit(1 - LEAST_SCORE)), F.lit(LEAST_SCORE))
    odds = F.log(score / (1 - score))
    return [tuple(r) for r in once.groupBy("_lang", F.floor(odds / BIN).cast("int").alias("bin")).agg(F.sum("_label"), F.count("*")).collect()]


def calibrate(model: Model, counts: list[tuple[str | None, int, int, int]]) -> None:
    """Moves the score so that 0.5 is the cut for all languages together, and sets the threshold of each language.

    A language's cut is the best one for its own rows with a share of the rows of all languages, of PRIOR positive rows,
    and is drawn to the common cut as by PRIOR positive rows; so is the common cut to 0.5.
    """
    found = sorted({b for _, b, _, _ in counts})
    place, bins = {b: k for k, b in enumerate(found)}, np.array(found)
    own: dict[str | None, np.ndarray] = {}
    for name, b, positive, rows in counts:
        own.setdefault(name, np.zeros((2, len(bins))))[:, place[b]] += positive, rows
    pooled = sum(own.values(), np.zeros((2, len(bins))))
    total = pooled[0].sum()
    if not total:
        return
    common = best_cut(bins, *pooled) * total / (total + PRIOR)
    model.out_bias -= common
    for name, mine in own.items():
        # Own positive rows move the threshold away from the common cut as far as they outweigh PRIOR.
        best, n = best_cut(bins, *(mine + pooled * (PRIOR / total))), mine[0].sum()
        cut = (n * best + PRIOR * common) / (n + PRIOR) - common
        model.thresholds[name] = float(1 / (1 + np.exp(-cut)))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.crc32(col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model:
    """Fit on labelled rows outside ``held_out``, at most MOST_POSITIVE and MOST_NEGATIVE of them, whole texts of
    MOST_CHARS characters together.

    Labels that are null or not 0 or 1 are left out; of repeated labels the largest counts, of repeated documents
    the one whose text has the largest hash. Null and empty texts are texts without words. Without rows of both labels
    (an empty table has none) the score is a constant: the only label, or 0. All other labelled rows outside ``held_out``
    calibrate the thresholds. Columns of ``docs`` may have any names, only those given are read.
    """
    known = (
        labels.filter(col(label).isin(0, 1) & col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(col(doc_id).cast("long").alias("_id"))
        .agg(F.max(col(label)).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    chosen = known.filter("_label = 1").orderBy("_order").limit(MOST_POSITIVE).unionByName(known.filter("_label = 0").orderBy("_order").limit(MOST_NEGATIVE))

    def make():
        buckets = _Buckets()
        return lambda texts: [[hashed(x, buckets) for x in texts]]

    languages = col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    texts = docs.select(col(doc_id).cast("long").alias("_id"), col(text).alias("_text"), languages.alias("_lang"))
    content = F.xxhash64(F.coalesce("_text", F.lit("")))
    sizes = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_order").agg(F.max(F.struct(content.alias("hash"), F.coalesce(F.length("_text"), F.lit(0)).alias("n"))).alias("t"))
    picked, room = [], MOST_CHARS
    for i, _, t in sorted(sizes.collect(), key=lambda r: (r[1], r[0])):  # numbers of MOST_POSITIVE + MOST_NEGATIVE rows
        if t.n <= room:
            picked.append((i, t.hash))
            room -= t.n
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "_id long, _hash long")), "_id").filter(content == F.col("_hash")).join(F.broadcast(chosen), "_id")
    found = map_text(rows.select("_id", "_label", "_order", "_text"), make, "_text", [T.StructField("_ids", T.ArrayType(T.IntegerType()))]).drop("_text").toArrow()
    words = found.column("_ids").combine_chunks()
    flat, edges = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    best = {i: (order, i, y, k) for k, (i, y, order) in enumerate(zip(*(found.column(c).to_pylist() for c in ("_id", "_label", "_order")), strict=True))}
    ranked = sorted(best.values())
    used = ranked[int(len(ranked) * CALIBRATION) :]
    model = train([flat[edges[k] : edges[k + 1]].astype(np.int64) for *_, k in used], np.array([y for _, _, y, _ in used]))
    if model.constant is None:
        trained = docs.sparkSession.createDataFrame([(i,) for _, i, _, _ in used], "_id long")
        rest = known.join(F.broadcast(trained), "_id", "left_anti").select("_id", "_label")
        calibrate(model, score_counts(texts.join(sized_broadcast(rest), "_id"), model))
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with score (double, 0 to 1) of the whole text and rejected (boolean): the score reaches the threshold
    of the row's language (0.5 where the language, or null, has none).

    Null and empty texts have no words and get the model's score for that. Rows are independent, an empty table gives
    an empty result; columns named score or rejected (in any case) are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIM floats

    def make():
        buckets, tables = _Buckets(), shared.value.tables()
        return lambda texts: [shared.value.score([hashed(x, buckets) for x in texts], tables).astype(float)]

    scored = map_text(docs, make, text, [T.StructField("score", T.DoubleType())])
    cut = F.lit(0.5)
    for name, value in sorted(model.thresholds.items(), key=str):
        cut = F.when(col(lang).eqNullSafe(F.lit(name)), F.lit(value)).otherwise(cut) if lang in docs.columns else cut
    kept = others(docs.columns, "score", "rejected")
    return scored.select(*map(col, kept), "score", (F.col("score") >= cut).alias("rejected"))
