"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is that of their hashes. Cutting it into fragments cuts every document's set into pieces,
and the intersection of two sets is the sum of the intersections of their pieces:

1. Counting. Each fragment counts by how many sets its n-grams are held, and how many n-grams of each piece are held
   by another set too. Summed over the fragments that bounds every intersection: a set with fewer than the threshold
   of its n-grams shared at all links with nothing. Only the others, the open sets, go on; they are written once.
2. Candidates. Fragments count again among the open sets. Two sets that are similar enough share an n-gram among the
   rarest of either (the prefix); open sets that share one there form a bucket. Each bucket has a leader, the set whose
   n-grams are held most often, and proposes pairs with its leader only (a star): near copies of a text mostly link
   with the text itself.
3. Verification. Sets of proposed pairs are cut at fragment borders, each fragment counts partial overlaps, and the
   sums per pair are compared with the threshold.
4. Components of the links found so far. Buckets with one leader are a group. Groups whose sets are now in one component
   are done. In the others, pairs across components go on to verification unless the counts of step 2 prove them apart:
   two sets have at most the smaller number of shared n-grams of either in common, in each range of the order. After
   that no link can be missing.

Equal sets are one node throughout, so exact copies cost one lookup each. N-grams that many sets of a task hold are
counted there and sent once. A bucket that many sets share is cut into blocks, a large group into parts, and each pair
of blocks or parts is a task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, col, distinct, fresh, map_text, materialize, release, sid, sized_broadcast, skew_safe_left_join
from .components import components

#: Contract values: words of a shingle, and the similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Shingles that a Python worker holds before it passes them on, and entries of a fragment.
CHUNK, FRAGMENT = 600_000, 2_000_000
#: Sets of a chunk that hold an n-gram, from which on they are counted there.
LOCAL = 16
#: N-grams that FREQUENT sets hold are last in a set's prefix order, most frequent last: the MOST_FREQUENT most frequent of
#: them (this decides cost, not results).
FREQUENT, MOST_FREQUENT = 8, 1 << 18
#: Parts of the order that sets are cut into in verification; sets of a block, pairs of a bin, members of a group's part.
PIECES, BLOCK, BIN, GROUP = 4, 50_000, 4096, 4096
#: Ranges of the order in which a set's shared n-grams are counted (a power of two), to bound intersections.
RANGES = 64

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
#: What an entry of a bucket fragment is: in the longer prefix, in the shorter one, an n-gram to count, a mark that several sets hold it.
_IN, _INNER, _COUNTS, _HELD = 1, 2, 4, 8


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = out
        return out


def shingles(text: str | None, words: int = WORDS, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.split cuts at the contract's white space and
    bytes.lower changes A-Z only. With fewer words than ``words`` there is one shingle of all, without words none."""
    known = _WordHashes() if known is None else known
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for o in range(width):
        acc = (acc ^ h[o : o + n]) * _M1
        acc ^= acc >> np.uint64(29)
    return distinct(acc * _M2)


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many first n-grams of a set with ``n`` meet a similar set: with any partner, and with one that is not smaller.

    A common n-gram lies in the longer prefix of the larger set and in the shorter prefix of the smaller one.
    """
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _least_common(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The intersection that sets of these sizes need."""
    return -(-percent * (x.astype(np.int64) + y) // (100 + percent))


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    made = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, columns.values(), strict=True)], names=list(columns))


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    release()
    known = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield i, shingles(x, words, known)
    del known
    release()


def _chunks(sets: Iterable[tuple]) -> Iterator[dict[int, tuple]]:
    """Distinct sets by node, CHUNK shingles at a time, of (node, hashes, ...)."""
    held, size = {}, 0
    for node, s, *more in sets:
        if len(s):
            held[node] = (s, *more)
            size += len(s)
            if size >= CHUNK:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _fragment(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _key(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What counting knows of an n-gram: its fragment and 32 bits. Others that fall together with it only make it look
    more shared than it is."""
    return (_fragment(hashes, bits).astype(np.uint64) << np.uint64(32)) | (hashes & _LOW)


def fragment_bits(entries: float) -> int:
    """Fragments of about FRAGMENT entries, as a power of two of them."""
    return max(3, math.ceil(math.log2(max(1.0, entries / FRAGMENT))))


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run."""
    if len(sorted_values):
        starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
        yield from zip(sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)], strict=True)


def _locally_frequent(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each n-gram of a chunk is held there by LOCAL sets or more; these n-grams and their numbers of sets."""
    ordered = np.sort(flat)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.diff(np.r_[starts, len(ordered)])
    often = times >= LOCAL
    values = ordered[starts[often]]
    at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
    return (values[at] == flat) if len(values) else np.zeros(len(flat), bool), values, times[often]


def summaries(docs: DataFrame, words: int, bits: int, chunks: float) -> DataFrame:
    """Three kinds of rows. kind 0: a document (doc_id, its set ``node``, its size n; local: how many of its n-grams its task
    found to be shared; p: sum of the logarithms of their numbers of sets, taken as ``chunks`` times those in the chunk).
    kind 1: for sets of the bin n, what one fragment adds to these two figures (nodes, shared and weights, packed). kind 2:
    n sets hold the n-gram with the key ``node``."""
    columns = {"fragment": pa.int32(), **dict.fromkeys(("x", "y", "z", "m", "k"), pa.binary())}
    columns_out = ["kind", "doc_id", "n", "node", "local", "p", "nodes", "shared", "weights"]
    fragments, least = 1 << bits, FREQUENT

    def emit(batches):
        rows: list[tuple] = []

        def passed():
            for i, s in _sets(batches, words):
                rows.append((i, len(s), node := set_id(s)))
                yield node, s

        def documents(shared: dict[int, tuple[int, float]]):
            ids, sizes, nodes = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            local = np.array([shared.get(r[2], (0, 0.0)) for r in rows], np.float64)
            rows.clear()
            out = [x.tobytes() for x in (ids, sizes, nodes, local[:, 0], local[:, 1])]
            return (-1 - xxhash.xxh3_64_intdigest(out[2]) % fragments, *out)

        for held in _chunks(passed()):
            nodes = np.fromiter(held, np.int64, len(held))
            flat = np.concatenate([s for s, in held.values()])
            owners = np.repeat(np.arange(len(nodes)), [len(s) for s, in held.values()])
            local, values, times = _locally_frequent(flat)
            counted = np.bincount(owners[local], minlength=len(nodes))
            weights = np.bincount(owners[local], np.log2(chunks * times[np.searchsorted(values, flat[local])]), len(nodes))
            flat, owners = flat[~local], owners[~local]
            fragment = _fragment(flat, bits)
            order = np.argsort(fragment * len(nodes) + owners, kind="stable")
            flat, owners, fragment = (flat[order] & _LOW).astype(np.uint32), owners[order], fragment[order]
            marks = {f: (lo, hi) for f, lo, hi in _runs(_fragment(values, bits))}
            made = [documents(dict(zip(nodes.tolist(), zip(counted.tolist(), weights.tolist(), strict=True), strict=True)))]
            for f, lo, hi in _runs(fragment):
                who, counts = np.unique(owners[lo:hi], return_counts=True)
                a, b = marks.pop(f, (0, 0))
                made.append((f, flat[lo:hi].tobytes(), counts.astype(np.int32).tobytes(), nodes[who].tobytes(), (values[a:b] & _LOW).astype(np.uint32).tobytes(), times[a:b].astype(np.int32).tobytes()))
            made += [(f, b"", b"", b"", (values[a:b] & _LOW).astype(np.uint32).tobytes(), times[a:b].astype(np.int32).tobytes()) for f, (a, b) in marks.items()]
            yield _batch(made, columns)
        if rows:
            yield _batch([documents({})], columns)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fragment"].iloc[0])
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
        if f < 0:
            ids, n, nodes = (read(c, np.int64) for c in "xyz")
            return pd.DataFrame({"kind": 0, "doc_id": ids, "n": n, "node": nodes, "local": read("m", np.float64).astype(np.int64), "p": read("k", np.float64), "nodes": b"", "shared": b"", "weights": b""})[columns_out]
        counts = read("y", np.int32)
        nodes, owner = np.unique(read("z", np.int64), return_inverse=True)
        pairs = read("x", np.uint32).astype(np.uint64) << np.uint64(32)
        pairs |= np.repeat(owner.astype(np.uint64), counts)
        pairs.sort()
        if len(pairs):
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]  # a set may come from several chunks
        grams = (pairs >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
        times = np.diff(np.r_[starts, len(grams)])
        marked, mark = np.unique(read("m", np.uint32), return_inverse=True)
        known = distinct(np.concatenate([grams[starts], marked]))
        held = np.zeros(len(known), np.int64)
        held[np.searchsorted(known, grams[starts])] = times
        held[np.searchsorted(known, marked)] += np.bincount(mark, read("k", np.int32), len(marked)).astype(np.int64)
        own = np.repeat(held[np.searchsorted(known, grams[starts])].astype(np.int32), times)
        owner = (pairs[own > 1] & _LOW).astype(np.uint32)
        shared = np.bincount(owner, minlength=len(nodes))
        weight = np.bincount(owner, np.log2(own[own > 1]), len(nodes))
        del pairs, grams, own, owner
        often = np.flatnonzero(held >= least)
        often = often[np.argsort(-held[often], kind="stable")[:MOST_FREQUENT]]
        keys = (np.uint64(f) << np.uint64(32) | known[often].astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(shared)
        bins = _fragment(nodes[some].view(np.uint64), bits)
        some = some[np.argsort(bins, kind="stable")]
        packed = [(b, *[x[some[lo:hi]].astype(k).tobytes() for x, k in ((nodes, np.int64), (shared, np.int32), (weight, np.float32))]) for b, lo, hi in _runs(np.sort(bins))]
        release()
        return pd.concat(
            [
                pd.DataFrame(packed, columns=["n", "nodes", "shared", "weights"]).assign(kind=1, doc_id=0, node=0, local=0, p=0.0),
                pd.DataFrame({"kind": 2, "doc_id": 0, "n": held[often], "node": keys, "local": 0, "p": 0.0, "nodes": b"", "shared": b"", "weights": b""}),
            ]
        )[columns_out]

    blocks = docs.mapInArrow(emit, "fragment int, x binary, y binary, z binary, m binary, k binary")
    return blocks.groupBy("fragment").applyInPandas(count, "kind int, doc_id long, n long, node long, local long, p double, nodes binary, shared binary, weights binary")


def shared_by_set(found: DataFrame) -> DataFrame:
    """(node, shared, weight): the sums over the fragments. From rows of kind 1."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
        nodes, owner = np.unique(read("nodes", np.int64), return_inverse=True)
        return pd.DataFrame({"node": nodes, "shared": np.bincount(owner, read("shared", np.int32)).astype(np.int64), "weight": np.bincount(owner, read("weights", np.float32))})

    return found.filter("kind = 1").select("n", "nodes", "shared", "weights").groupBy("n").applyInPandas(add, "node long, shared long, weight double")


def _order(frequent: tuple[np.ndarray, np.ndarray], s: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the set's n-grams in the order of prefixes, and how many sets hold each if that is frequent, else 0."""
    values, counts = frequent
    if not len(values):
        return np.arange(len(s)), np.zeros(len(s), np.int64)
    keys = _key(s, bits)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    often = np.where(values[at] == keys, counts[at], 0)
    order = np.argsort(often, kind="stable")
    return order, often[order]


def open_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, n, p, hashes) of each document (doc_id, text, p)."""
    columns = {"node": pa.int64(), "n": pa.int64(), "p": pa.float64(), "hashes": pa.binary()}

    def make(batches):
        known = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for x, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    s = shingles(x, words, known)
                    rows.append((set_id(s), len(s), p, s.tobytes()))
                yield _batch(rows, columns)
        del known
        release()

    return docs.select("doc_id", "text", "p").mapInArrow(make, "node long, n long, p double, hashes binary")


def buckets(sets: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray], counted_bits: int, bits: int) -> DataFrame:
    """Two kinds of rows. kind 0: a bucket of at least two sets: mark (of equal buckets), its leader, size, nodes and
    sizes, packed, the leader first; a size is twice the number of n-grams, plus one if the bucket's n-gram is in the
    shorter prefix. kind 1: how many n-grams of the set ``leader`` other sets hold too, in the ranges from ``size`` on
    (sizes, packed)."""
    shared, block = sets.sparkSession.sparkContext.broadcast(frequent), BLOCK  # MOST_FREQUENT rows at most
    columns = {"fragment": pa.int32(), **dict.fromkeys(("keys", "flags", "counts", "nodes", "sizes", "weights"), pa.binary())}
    per = max(1, RANGES >> bits)  # ranges of a fragment
    shift = np.uint64(64 - RANGES.bit_length() + 1)

    def stored(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for node, p, h in zip(*(part.column(c).to_pylist() for c in ("node", "p", "hashes")), strict=True):
                    yield node, np.frombuffer(h, np.uint64), p

    def emit(batches):
        often = shared.value
        for held in _chunks(stored(batches)):
            nodes, lengths = np.fromiter(held, np.int64, len(held)), np.array([len(s) for s, _ in held.values()])
            weights = np.array([p for _, p in held.values()], np.float32)
            flat = np.concatenate([s for s, _ in held.values()])
            owners = np.repeat(np.arange(len(nodes)), lengths)
            local, values, _ = _locally_frequent(flat)
            flags = np.where(local, 0, _COUNTS).astype(np.uint8)
            extra: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            base = 0
            for i, (s, _) in enumerate(held.values()):
                order, counts = _order(often, s, counted_bits)
                first, inner = prefix_sizes(len(s), percent)
                places, kinds, blocks = order[:first], np.where(np.arange(first) < inner, _IN | _INNER, _IN).astype(np.uint8), -(-counts[:first] // block)
                if (many := blocks > 1).any():  # a copy for each pair of blocks with the node's own
                    for place, kind, b in zip(places[many], kinds[many], blocks[many], strict=True):
                        own, every = np.uint64(int(nodes[i]) % int(b)), np.arange(int(b), dtype=np.uint64)
                        pair = np.minimum(own, every) * np.uint64(b) + np.maximum(own, every)
                        extra.append(((s[place] ^ (pair + np.uint64(1)) * _M1) * _M2, np.full(int(b), kind, np.uint8), np.full(int(b), i)))
                    places, kinds = places[~many], kinds[~many]
                flags[base + places] |= kinds
                base += len(s)
            if len(values):  # counted here: the places of each set in each range
                spread = np.bincount(owners[local] * RANGES + (flat[local] >> shift).astype(np.int64), minlength=len(nodes) * RANGES).reshape(-1, RANGES)
                some = np.flatnonzero(spread.any(1))
                yield _batch([(-1 - int(nodes[i]) % 64, b"", b"", spread[i].astype(np.int32).tobytes(), nodes[i].tobytes(), b"", b"") for i in some], columns)
            sent = flags > 0
            keys = np.concatenate([flat[sent], values, *[e[0] for e in extra]])
            kinds = np.concatenate([flags[sent], np.full(len(values), _HELD, np.uint8), *[e[1] for e in extra]])
            who = np.concatenate([owners[sent], np.zeros(len(values), np.int64), *[e[2] for e in extra]])
            fragment = _fragment(keys, bits)
            order = np.argsort(fragment * len(nodes) + who, kind="stable")
            keys, kinds, who, fragment = keys[order], kinds[order], who[order], fragment[order]
            rows = []
            for f, lo, hi in _runs(fragment):
                owner, counts = np.unique(who[lo:hi], return_counts=True)
                rows.append((f, *[x.tobytes() for x in (keys[lo:hi], kinds[lo:hi], counts.astype(np.int32), nodes[owner], lengths[owner].astype(np.int32), weights[owner])]))
            yield _batch(rows, columns)
        release()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fragment"].iloc[0])
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
        if f < 0:
            return pd.DataFrame({"kind": 1, "mark": 0, "leader": read("nodes", np.int64), "size": 0, "nodes": b"", "sizes": pdf["counts"].to_numpy()})
        keys, flags, times = read("keys", np.uint64), read("flags", np.uint8), read("counts", np.int32)
        nodes, sizes, weights = (np.repeat(read(c, kind), times) for c, kind in (("nodes", np.int64), ("sizes", np.int32), ("weights", np.float32)))
        # How many n-grams of each set others hold too. Sets are distinct, so a set has an n-gram once.
        counting = np.flatnonzero(flags & (_COUNTS | _HELD))
        order = counting[np.argsort(keys[counting], kind="stable")]
        some = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.zeros(0, bool)
        starts = np.flatnonzero(some)
        held = np.add.reduceat(np.where(flags[order] & _HELD, 2, 1), starts) if len(starts) else starts
        shared = order[np.repeat(held > 1, np.diff(np.r_[starts, len(order)])) & ((flags[order] & _COUNTS) > 0)]
        owner, at = np.unique(nodes[shared], return_inverse=True)
        lowest = f * per if per > 1 else f >> (bits - RANGES.bit_length() + 1)
        spread = np.bincount(at * per + (keys[shared] >> shift).astype(np.int64) - lowest, minlength=len(owner) * per).reshape(-1, per).astype(np.int32)
        counted = pd.DataFrame({"kind": 1, "mark": 0, "leader": owner, "size": lowest, "nodes": b"", "sizes": [x.tobytes() for x in spread]})
        # Buckets
        inside = np.flatnonzero(flags & _IN)
        order = inside[np.lexsort((nodes[inside], -weights[inside], keys[inside]))]
        keys, nodes, sizes = keys[order], nodes[order], 2 * sizes[order] + ((flags[order] & _INNER) > 0)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(keys)].astype(np.int64)[: len(starts)]
        mixed = (nodes.view(np.uint64) * np.uint64(2) + (sizes & 1).astype(np.uint64)) * _M1
        mixed ^= mixed >> np.uint64(31)
        mark = np.add.reduceat(mixed * _M2, starts) if len(starts) else np.zeros(0, np.uint64)
        several = np.flatnonzero(ends - starts > 1)
        several = several[np.unique(mark[several], return_index=True)[1]]
        found = pd.DataFrame(
            {
                "kind": 0,
                "mark": mark[several].view(np.int64),
                "leader": nodes[starts[several]],
                "size": (ends - starts)[several],
                "nodes": [nodes[starts[i] : ends[i]].tobytes() for i in several],
                "sizes": [sizes[starts[i] : ends[i]].astype(np.int32).tobytes() for i in several],
            }
        )
        return pd.concat([found, counted])

    blocks = sets.select("node", "p", "hashes").mapInArrow(emit, "fragment int, keys binary, flags binary, counts binary, nodes binary, sizes binary, weights binary")
    return blocks.groupBy("fragment").applyInPandas(meet, "kind int, mark long, leader long, size long, nodes binary, sizes binary")


def shared_by_range(found: DataFrame, bins: int) -> DataFrame:
    """(node, shared, counts): n-grams of each set that others hold too, in all and by range (packed). From rows of kind 1."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, owner = np.unique(pdf["leader"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(nodes), RANGES), np.int32)
        for i, at, x in zip(owner, pdf["size"], pdf["sizes"], strict=True):
            part = np.frombuffer(x, np.int32)
            sums[i, at : at + len(part)] += part
        return pd.DataFrame({"node": nodes, "shared": sums.sum(1), "counts": [x.tobytes() for x in sums]})

    rows = found.filter("kind = 1").select("leader", "size", "sizes", F.pmod(F.xxhash64("leader"), F.lit(bins)).alias("bin"))
    return rows.groupBy("bin").applyInPandas(add, "node long, shared long, counts binary")


def _fits(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these (marked) sizes can be similar enough, and meet first where they do now."""
    small, large = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
    return ((small >> 1) * 100 >= (large >> 1) * percent) & (((small & 1) == 1) | ((small >> 1 == large >> 1) & ((large & 1) == 1)))


def members(found: DataFrame) -> DataFrame:
    """(leader, node, n) of each member of the buckets, n as a marked size."""

    def spread(frames):
        for pdf in frames:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                out = pd.DataFrame(
                    {
                        "leader": np.repeat(part["leader"].to_numpy(), part["size"].to_numpy()),
                        "node": np.concatenate([np.frombuffer(x, np.int64) for x in part["nodes"]]),
                        "n": np.concatenate([np.frombuffer(x, np.int32) for x in part["sizes"]]),
                    }
                )
                yield out.groupby(["leader", "node"], as_index=False, sort=False).max()

    spread_ = found.filter("kind = 0").select("leader", "size", "nodes", "sizes").mapInPandas(spread, "leader long, node long, n int")
    return spread_.groupBy("leader", "node").agg(F.max("n").alias("n"))


def star_pairs(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): the leader of each group with each other set of a fitting size."""
    leaders = grouped.filter("leader = node").select("leader", F.col("n").alias("own"))
    size = lambda c: F.shiftright(c, 1)
    small, large = F.least(size("n"), size("own")), F.greatest(size("n"), size("own"))
    pairs = grouped.filter("leader <> node").join(leaders, "leader").filter(small * 100 >= large * percent)
    return pairs.select(F.col("leader").alias("a"), F.col("node").alias("b"), size("own").alias("na"), size("n").alias("nb"))


def _pieces(sets: DataFrame) -> DataFrame:
    """(node, piece, hashes): the sets cut at the borders of PIECES parts of the order."""
    borders = np.arange(1, PIECES, dtype=np.uint64) * np.uint64((1 << 64) // PIECES)
    columns = {"node": pa.int64(), "piece": pa.int32(), "hashes": pa.binary()}

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for node, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = np.frombuffer(h, np.uint64)
                    rows += [(node, i, x.tobytes()) for i, x in enumerate(np.split(s, np.searchsorted(s, borders)))]
                yield _batch(rows, columns)

    return sets.select("node", "hashes").mapInArrow(cut, "node long, piece int, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) whose sets are similar enough: overlaps counted by pieces and summed."""
    total = pairs.count()
    if not total:
        return pairs.select("a", "b")
    hot = pairs.groupBy("a").count().filter(F.col("count") > BIN).select("a", F.ceil(F.col("count") / BIN).alias("parts"))
    bins = max(12, math.ceil(total / BIN))
    binned = pairs.join(sized_broadcast(hot), "a", "left")  # total / BIN rows at most
    binned = materialize(binned.select("a", "b", "na", "nb", F.pmod(F.xxhash64("a", F.pmod("b", F.coalesce("parts", F.lit(1)))), F.lit(bins)).alias("bin")), "pairs")
    places = materialize(binned.select("a", "bin").unionByName(binned.select(F.col("b").alias("a"), "bin")).distinct().select(F.col("a").alias("node"), "bin"), "places")
    wanted = sets.join(sized_broadcast(places.select("node").distinct()), "node", "left_semi")
    dealt = _pieces(wanted).join(places, "node")
    spread = binned.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {n: np.frombuffer(h, np.uint64) for n, h in zip(right["node"], right["hashes"], strict=True)}
        out = []
        for a, part in left.groupby("a", sort=False):
            mine, others = held[a], part["b"].to_numpy()
            pieces = [held[b] for b in others]
            lengths = np.array([len(p) for p in pieces])
            flat = np.concatenate(pieces)
            if not len(mine) or not len(flat):
                shared = np.zeros(len(others), np.int64)
            else:
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                sums = np.r_[0, np.cumsum(mine[at] == flat)]
                ends = np.cumsum(lengths)
                shared = sums[ends] - sums[ends - lengths]
            out.append(pd.DataFrame({"a": a, "b": others, "na": part["na"].to_numpy(), "nb": part["nb"].to_numpy(), "shared": shared}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "na": [], "nb": [], "shared": []})

    partial = spread.groupBy("bin", "piece").cogroup(dealt.groupBy("bin", "piece")).applyInPandas(count, "a long, b long, na int, nb int, shared long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return summed.filter(F.col("shared") * 100 >= (F.col("na").cast("long") + F.col("nb") - F.col("shared")) * percent).select("a", "b")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in each open group (or pair of its parts ``one`` and ``other``) that the counts of shared
    n-grams don't prove apart. ``rows``: leader, one, other, part (the row's own), node, n (marked), root, shared, counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        node, n, root, part, shared = (pdf[c].to_numpy() for c in ("node", "n", "root", "part", "shared"))
        size, both = (n >> 1).astype(np.int64), pdf["one"].iloc[0] != pdf["other"].iloc[0]
        counts = np.stack([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        out = []
        for i in range(len(node)):  # by size, so partners are one slice
            # A partner that is no smaller shares size[j] n-grams with this one at most as far as its shared ones reach.
            largest = min(size[i] * 100 // percent, shared[i] * (100 + percent) // percent - size[i])
            hi = np.searchsorted(n, 2 * largest + 1, "right")
            if hi <= i + 1:
                continue
            j = i + 1 + np.flatnonzero((root[i + 1 : hi] != root[i]) & (shared[i + 1 : hi] >= _least_common(size[i + 1 : hi], size[i], percent)))
            j = j[_fits(n[i], n[j], percent)]
            if both:
                j = j[part[j] != part[i]]
            for at in range(0, len(j), 4096):
                k = j[at : at + 4096]
                k = k[np.minimum(counts[k], counts[i]).sum(1, dtype=np.int64) >= _least_common(size[k], size[i], percent)]
                if len(k):
                    out.append(np.stack([np.full(len(k), i), k]))
        i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": node[i], "b": node[j], "na": size[i].astype(np.int32), "nb": size[j].astype(np.int32)})

    return rows.groupBy("leader", "one", "other").applyInPandas(run, "a long, b long, na int, nb int").distinct()


def _open_pairs(grouped: DataFrame, roots: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in groups that hold several."""
    root = sized_broadcast(roots.select("node", "root"))
    rooted = materialize(grouped.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "ngram-rooted")
    several = rooted.groupBy("leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).filter("lo <> hi and members > 2")
    several = materialize(several.select("leader", F.ceil(F.col("members") / GROUP).alias("parts")), "ngram-open")
    dealt = rooted.join(sized_broadcast(several), "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("leader", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other"), "part", "node", "n", "root")
    return dealt.join(sized_broadcast(counted, limit=50_000), "node")


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id.

    A row's set has the distinct ``words``-word shingles of its text (A-Z in lower case; all words as one shingle if
    there are fewer). Rows link if 100 * intersection >= ``percent`` * union. component_id is the smallest doc_id
    reachable over links, class_id the smallest with the same set. A null, empty or blank text has no shingle and
    links with nothing: both ids are its own. A null doc_id counts as smaller than all others and is returned as
    null. Rows that share a doc_id are rows of their own. An empty table gives an empty result; other columns are not
    read. No cap is set on buckets, partners or candidates.
    """
    nodes, rows = linked_nodes(docs, words, percent, doc_id, text)
    full = skew_safe_left_join(rows, nodes, ["node"], "members")
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c))
    plain = lambda c: F.when(c != F.lit(NULL_ID), c)
    return full.select(plain(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), plain(own("class_id")).alias("class_id"), plain(own("component_id")).alias("component_id"))


def linked_nodes(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (node, root, class_id, component_id, members) of each set, root being one of its component, and
    (doc_id, n, node) of each row."""
    docs = docs.select(sid(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    n_words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6  # a word and its space are six characters or so
    counted_bits = fragment_bits(n_words)
    found = materialize(summaries(docs, words, counted_bits, max(1.0, n_words / CHUNK)), "ngram-summaries")
    rows = found.filter("kind = 0").select("doc_id", "n", "node")
    # A set's own task has counted some of its n-grams as shared. Any one of several tasks gives a bound.
    classes = found.filter("kind = 0 and n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), F.min("local").alias("local"), F.max("p").alias("own"))
    classes = classes.join(shared_by_set(found), "node", "left").withColumn("open", (F.coalesce("shared", F.lit(0)) + F.col("local")) * 100 >= F.col("n") * percent)
    classes = materialize(classes.withColumn("p", (F.coalesce("weight", F.lit(0.0)) + F.col("own")) / F.col("n")).select("node", "n", "doc_id", "members", "open", "p"), "ngram-classes")
    often = found.filter("kind = 2").select("node", "n").orderBy(F.desc("n"), "node").limit(MOST_FREQUENT).toArrow()
    values, counts = often.column("node").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(values)
    going = classes.filter("open")
    wanted = materialize(going.groupBy("doc_id").agg(F.max("p").alias("p"), F.sum("n").alias("n")), "ngram-going")
    some, entries = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = materialize(open_sets(docs.join(sized_broadcast(wanted.select("doc_id", "p"), some), "doc_id") if some else docs.limit(0).withColumn("p", F.lit(0.0)), words), "ngram-sets")
    if sets.count() > sets.select("node").distinct().count():  # rows that share a doc_id
        sets = materialize(sets.dropDuplicates(["node"]), "ngram-sets")
    met = materialize(buckets(sets, percent, (values[order], counts[order]), counted_bits, fragment_bits(entries)), "ngram-buckets")
    grouped = materialize(members(met), "ngram-groups")
    links = materialize(verified(materialize(star_pairs(grouped, percent), "ngram-stars"), sets, percent), "ngram-links")
    roots = materialize(components(links), "ngram-roots")
    counted = materialize(shared_by_range(met, max(12, some // 100_000)), "ngram-counts")
    more = materialize(_across(_open_pairs(grouped, roots, counted, percent), percent), "ngram-pairs")
    if more.limit(1).count():
        more = materialize(verified(more, sets, percent), "ngram-links")
        if more.limit(1).count():
            roots = materialize(components(links.unionByName(more)), "ngram-roots")
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    nodes = rooted.join(named, "root").select("node", "root", F.col("doc_id").alias("class_id"), "component_id", "members")
    return materialize(nodes, "ngram-nodes"), rows


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component of ``link_components``.

    The row with the smallest doc_id stays (null comes first); where rows of one component share it, the one with the
    smallest set hash, and one of equal rows. Rows without words all stay. Rows that share a doc_id with a dropped row but
    not its component stay. Columns may have any names.
    """
    nodes, rows = linked_nodes(docs, words, percent, doc_id, text)
    first = nodes.groupBy("root").agg(F.min(F.struct("class_id", "node")).alias("first")).select("first.*").withColumnRenamed("class_id", "kept_id")
    nodes = materialize(nodes.select("node", "members").join(first, "node", "left"), "ngram-kept")
    found = skew_safe_left_join(rows.filter("n > 0"), nodes, ["node"], "members")
    gone = materialize(found.filter("kept_id is null or doc_id <> kept_id").select("doc_id", "node").distinct(), "ngram-gone")
    id_, node, n, twin, same = fresh(docs.columns, "__id", "__node", "__n", "__twin", "__same")
    marked = docs.withColumn(id_, sid(doc_id))
    if not rows.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return marked.join(sized_broadcast(gone.select(F.col("doc_id").alias(id_))), id_, "left_anti").drop(id_)

    def make():
        known = _WordHashes()

        def sets(texts):
            found = [shingles(x, words, known) for x in texts]
            return [set_id(s) if len(s) else None for s in found], [len(s) for s in found]

        return sets

    marked = map_text(marked, make, text, [T.StructField(node, T.LongType()), T.StructField(n, T.LongType())])
    left = marked.join(sized_broadcast(gone.select(F.col("doc_id").alias(twin), F.col("node").alias(same))), (F.col(id_) == F.col(twin)) & F.col(node).eqNullSafe(F.col(same)), "left_anti")
    once = left.filter(F.col(n) > 0).dropDuplicates([id_, node]).union(left.filter(F.col(n) == 0))
    return once.select(*map(col, docs.columns))
