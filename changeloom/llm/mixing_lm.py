"""Language-model scores by online logistic context mixing, beside a word-count base.

A text is coded as bits: its bytes (A-Z lower-cased) and one end, each by its path in the Huffman tree of what
follows the byte before. For each bit, several predictors look up how often it was 1 in their hashed context (the last 2, 4 and 6
bytes, the word so far) at this node of the tree. Their log odds are added with weights gated by the node, refined by
a table of the last byte and the odds so far, and the weights move with the text as it is read. The sum of
the bits' log probabilities is the text's; the bits a byte are that, divided by its bytes.

Training deals all training texts to shards by their hash, as many as their bytes ask for, and orders each shard by it. A
learner predicts the bits of every text of its shard from what it has counted so far, moves the weights online, and counts the
bits. Counts are packed, shuffled by slice and added; weights are averaged in the order of the shards. So neither partitions nor
lost executors change a score. The tables have a fixed number of slots, which bounds what is broadcast.

The base adds, over words and one end a text, log10((c + 0.1) / (N + 0.1 (V + 1))). Words are known by 64-bit hashes.
Those with more than one in HOT_WORDS of all, fewer than HOT_WORDS, are broadcast; the others are joined in a shuffle.

Cases: a null or empty text is one end; a null doc_id is learned from; rows that repeat an id are learned from and scored
each; without training texts all tables are empty and each bit has probability 1/2; further columns are ignored; an
empty table gives no rows; in a text of more than 1 MB contexts and weights start anew at each MB, and none of it is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, map_text, pick, slices, small_batches

ORDERS = (2, 4, 6)
PREDICTORS = len(ORDERS) + 1
SLOTS = 1 << 22  # of each predictor
LINE = 64  # slots of a context at a time: what a context's nodes need lies together
SLICE = 1 << 16  # slots that are added in one place
FOLDS, HOT_WORDS = 10, 1 << 21
HELD_WORDS = 6_000_000  # that a task holds before it counts them
SEGMENT = 1 << 20  # bytes of a text after which contexts start anew
GROUP = 1 << 16  # bytes that are handled as one array
AT_ONCE = 1 << 14  # symbols whose bits are looked up at once when texts are scored
SHARD = 32 << 20  # bytes of training texts that one learner reads, about
FIRST_BLOCK = 128  # bytes of a text after which its weights first move; blocks double
ODDS, STEP = 7.9, 16  # largest log odds of a predictor, and steps in a unit
RATE = 0.1  # of a text's weights
BUCKETS = 24  # of log odds in the refining table
END = 256
U = np.uint64
_WHITE = np.isin(np.arange(257), [32, 9, 10, 11, 12, 13, 0, 256])


@dataclass
class Code:
    """Paths of symbols after each byte (row 256 * 257 on: unused): place in the arrays below, and length."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    sign: np.ndarray  # 1 for a bit of 1, -1 for 0
    offset: np.ndarray  # the node's place in a context's line of slots
    step: np.ndarray  # the node, and 256 more for a bit of 1: what is looked up for each bit


def code(counts: np.ndarray) -> Code:
    """counts: 256 x 257, symbols after each byte. Each byte has a Huffman tree; symbols not seen after it have paths too.

    A tree's nodes are numbered from its root, so that the low numbers, which gate weights, are the frequent ones.
    """
    after, all_of = counts.reshape(256, 257), counts.reshape(256, 257).sum(axis=0)
    lengths, starts, nodes, bits, at_all = [], [], [], [], 0
    for row in after:
        # what was seen after the byte counts most, then what was seen at all
        heap = [((int(c) << 40) + (int(a) << 9) + 1, s) for s, (c, a) in enumerate(zip(row, all_of, strict=True))]
        heapq.heapify(heap)
        above: list[tuple[int, int]] = [(0, 0)] * 513
        for made in range(257, 513):
            (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i], above[j] = (made, 0), (made, 1)
            heapq.heappush(heap, (x + y, made))
        for s in range(257):
            path, at = [], s
            while at != 512:
                at, bit = above[at]
                path.append((512 - at, bit))
            starts.append(at_all)
            lengths.append(len(path))
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            at_all += len(path)
    node = np.array(nodes, np.uint8)
    step = node + np.array(bits, np.int16) * np.int16(256)
    return Code(np.array(starts), np.array(lengths), node.astype(np.int64), np.array(bits, np.float32) * 2 - 1, (node % LINE).astype(np.uint32), step)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return np.cumprod(np.full(n, base, U)), np.cumprod(np.full(n, pow(base, -1, 1 << 64), U))


def contexts(cat: np.ndarray) -> np.ndarray:
    """A 22-bit hash of each predictor's context (a row each) before each symbol of cat (segments parted by zeros)."""
    top = U(64 - int(np.log2(SLOTS)))
    b = np.concatenate((np.zeros(8, U), (cat & 255).astype(U)))  # END counts as zero
    n, own, out = len(cat), b[8:], np.empty((len(cat), PREDICTORS), np.int32)  # a symbol's hashes side by side
    two = b[1:-1] | b[:-2] << U(8)  # the last two bytes, from the third place of b on
    last = {2: two[6:], 4: two[6:] | two[4:-2] << U(16)}
    last[6] = last[4] | two[2:-4] << U(32)
    for i, k in enumerate(ORDERS):
        out[:, i] = ((last[k] + U(k << 56)) * U(0xD6E8FEB86659FD93)) >> top
    power, inverse = _powers(1 << (max(1, n + 1) - 1).bit_length())
    sums = np.concatenate((np.zeros(1, U), np.cumsum((own + U(1)) * power[:n])))
    white = _WHITE.take(cat)
    start = np.maximum.accumulate(np.where(np.concatenate(([True], white[:-1])), np.arange(n), 0)) if n else np.zeros(0, np.int64)
    so_far = (sums[:n] - look(sums, start)) * look(inverse, start)
    so_far = (so_far ^ (so_far >> U(31))) * U(0xBF58476D1CE4E5B9)
    out[:, -1] = so_far >> top
    return out.T


def keep_freed() -> None:
    """Frees a block of 30 MB, after which malloc keeps what smaller arrays free, and doesn't ask the system for it again each time."""
    np.empty(30 << 20, np.uint8)


def look(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are there, so without the time that checking them takes."""
    return table.take(at, mode="wrap")


@dataclass
class Bits:
    """The bits of some symbols: node, whether it is 1, the refining table's row, each predictor's slot."""

    node: np.ndarray
    one: np.ndarray
    row: np.ndarray
    slots: list[np.ndarray]


def bits_of(cat: np.ndarray, hashed: np.ndarray, at: np.ndarray, tree: Code) -> Bits:
    before, sym = paths(cat, at)
    n = look(tree.length, sym)
    # what a symbol's bits share is repeated in two pieces: its place in the tree with the row, and the hashes side by side
    base = np.repeat((look(tree.start, sym) + n - np.cumsum(n) << 16) + before * BUCKETS, n)
    sides = np.repeat(look(hashed.T.view(np.complex128).ravel(), at), n).view(np.int32).reshape(-1, PREDICTORS)
    row = (base & 0xFFFF).astype(np.int16)
    base >>= 16
    base += np.arange(len(base))
    step = look(tree.step, base)
    node = (step & np.int16(255)).astype(np.intp)
    offset = node & (LINE - 1)
    return Bits(node, step > 255, row, [side ^ offset for side in sides.T])


def paths(cat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes before the symbols at these places, and the numbers of their paths in the tree."""
    before = look(cat, at - 1) & 255
    return before, before.astype(np.int64) * 257 + look(cat, at)


@dataclass
class Model:
    tree: Code
    odds: np.ndarray  # PREDICTORS x SLOTS, int8
    weights: np.ndarray  # PREDICTORS x 256
    refined: np.ndarray  # 256 x BUCKETS, log odds

    def refine(self, total: np.ndarray, row: np.ndarray) -> np.ndarray:
        cell = row + _bucket(total)
        return (total + look(self.refined.ravel(), cell)) * np.float32(0.5)


def _bucket(total: np.ndarray) -> np.ndarray:
    return (np.clip(total, -7.99, 7.99) * np.float32(BUCKETS / 16) + np.float32(BUCKETS / 2)).astype(np.int16)


def probability(total: np.ndarray) -> np.ndarray:
    p = np.tanh(total * np.float32(0.5))
    p *= np.float32(0.5)
    p += np.float32(0.5)
    return p


def fresh(tree: Code) -> Model:
    centre = (np.arange(BUCKETS) + 0.5 - BUCKETS / 2) * (16 / BUCKETS)
    return Model(tree, np.zeros((PREDICTORS, SLOTS), np.int8), np.full((PREDICTORS, 256), 0.4, np.float32), np.tile(centre.astype(np.float32), (256, 1)))


def symbols(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all symbols of segments, and which of these is the first of each segment."""
    n = end - start
    first = np.cumsum(n) - n
    at = np.repeat(start - first, n)
    at += np.arange(len(at))
    return at, first


def groups(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in segments, laid end to end with zeros between: the symbols; of each segment its text, start and end."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        t = (t or b"").lower()
        for a in range(0, max(1, len(t)), SEGMENT):
            own = np.frombuffer(t[a : a + SEGMENT], np.uint8).astype(np.int16)
            if a + SEGMENT >= len(t):
                own = np.append(own, np.int16(END))
            parts.append((i, own))
            size += len(own)
            if size >= GROUP:
                yield _laid(parts)
                parts, size = [], 0
    if parts:
        yield _laid(parts)


def _laid(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gap = np.zeros(max(ORDERS), np.int16)
    n = np.array([len(p) for _, p in parts])
    start = np.cumsum(n + len(gap)) - n
    return np.concatenate([x for _, p in parts for x in (gap, p)]), np.array([i for i, _ in parts]), start, start + n


def log_probabilities(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """log10 of each text's probability. A text's weights move after each block by the slope of its bits there."""
    out = np.zeros(len(texts))
    weights = model.weights / np.float32(STEP)
    for cat, text, start, end in groups(texts):
        hashed = contexts(cat)
        at, first = symbols(start, end)
        size = end - start
        bit = np.concatenate(([0], np.cumsum(look(model.tree.length, paths(cat, at)[1]))))  # the first of each symbol
        odds, total = np.empty((PREDICTORS, bit[-1]), np.float32), np.zeros(bit[-1], np.float32)
        one, row = np.empty(bit[-1], np.float32), np.empty(bit[-1], np.int16)
        for a in range(0, len(at), AT_ONCE):
            x, here = bits_of(cat, hashed, at[a : a + AT_ONCE], model.tree), slice(bit[a], bit[min(a + AT_ONCE, len(at))])
            one[here], row[here] = x.one, x.row
            for k, s in enumerate(x.slots):
                odds[k, here] = look(model.odds[k], s)
                w = look(weights[k], x.node)
                w *= odds[k, here]
                total[here] += w
        for j in np.flatnonzero(size > FIRST_BLOCK).tolist():
            move(odds, total, one, bit[first[j] : first[j] + size[j] + 1])
        for a in range(0, len(total), GROUP):
            here = slice(a, a + GROUP)
            refined = model.refine(total[here], row[here])
            refined *= 1 - 2 * one[here]
            np.exp(np.clip(refined, -30, 30, out=refined), out=refined)
            refined += 1
            np.log(refined, out=total[here])
        np.subtract.at(out, text, np.add.reduceat(total, bit[first], dtype=np.float64))
    return out / np.log(10)


def move(odds: np.ndarray, total: np.ndarray, one: np.ndarray, bit: np.ndarray) -> None:
    """Adds to the log odds of a text's bits what its weights have moved by in the blocks before; bit: the first of each symbol, and the end."""
    moved, lo, hi, n = np.zeros(PREDICTORS, np.float32), 0, FIRST_BLOCK, len(bit) - 1
    most = np.float32(0.5 / STEP)
    while lo < n:
        a, b = int(bit[lo]), int(bit[min(hi, n)])
        own, sums = odds[:, a:b], total[a:b]
        if lo:
            sums += moved @ own
        if hi < n:
            slope = own @ (one[a:b] - probability(sums))
            slope *= np.float32(RATE / (STEP * STEP * (b - a)))
            moved = np.maximum(np.minimum(moved + slope, most), -most)
        lo, hi = hi, 2 * hi


class Learner:
    """A task's tables, and the weights that it moves online."""

    def __init__(self, tree: Code):
        keep_freed()
        self.model = fresh(tree)
        self.counts = np.empty((PREDICTORS, SLOTS, 2), np.uint32)
        self.counts.fill(0)  # np.zeros would not ask for large pages, without which most lookups wait for an address
        self.both = self.counts.view(np.int64).reshape(PREDICTORS, SLOTS)  # a slot's two counts as one number: of 1 above, of 0 below
        self.slopes = np.full((PREDICTORS, 256), 1e-3)
        self.refining = np.zeros((2, 256 * BUCKETS))
        self.seen = 0.0
        self.held: list[bytes | None] = []
        self.size = 0

    def hold(self, texts: list[bytes | None]) -> None:
        """Reads texts in groups that don't depend on how they arrive."""
        for t in texts:
            self.held.append(t)
            self.size += len(t or b"")
            if self.size >= SEGMENT:
                self.finish()

    def finish(self) -> None:
        self.read(self.held)
        self.held, self.size = [], 0

    def read(self, texts: list[bytes | None]) -> None:
        for cat, _, start, end in groups(texts):
            hashed, at = contexts(cat), symbols(start, end)[0]
            self.move(bits_of(cat, hashed, at[a : a + AT_ONCE], self.model.tree) for a in range(0, len(at), AT_ONCE))

    def move(self, parts: Iterable[Bits]) -> None:
        n, slopes = np.zeros(256), np.zeros((PREDICTORS, 256))
        for b in parts:
            odds, one = [], np.where(b.one, np.int64(1 << 32), np.int64(1))
            for both, slot in zip(self.both, b.slots, strict=True):  # counted at once, while the slots are at hand
                odds.append(odds_of(look(both, slot).view(np.int32).reshape(-1, 2)))
                np.add.at(both, slot, one)
            total = np.zeros(len(b.node), np.float32)
            for st, weights in zip(odds, self.model.weights, strict=True):
                w = look(weights, b.node)
                w *= st
                total += w
            err = b.one - probability(total)
            n += np.bincount(b.node, minlength=256)
            for k, st in enumerate(odds):
                st *= err
                slopes[k] += np.bincount(b.node, st, 256)
            cell = b.row + _bucket(total)
            self.refining += np.stack([np.bincount(cell, minlength=256 * BUCKETS), np.bincount(cell, b.one, 256 * BUCKETS)])
            self.seen += len(b.node)
        slopes /= np.sqrt(np.maximum(n, 1))
        self.slopes += slopes**2
        self.model.weights += (0.3 * slopes / np.sqrt(self.slopes)).astype(np.float32)


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log odds of a 1 after counts of 0 and 1: 0 where nothing was counted, and within what int8 steps hold."""
    c = counts.astype(np.float32)
    c += np.float32(0.3)
    odds = c[..., 1] / c[..., 0]
    np.log(odds, out=odds)
    return np.clip(odds, -ODDS, ODDS, out=odds)


def trained_on(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS != 0, F.lit(True))


def symbol_counts(texts: DataFrame) -> np.ndarray:
    """256 x 257 counts of symbols after each byte (0 at a start) in texts(text): what a task sends is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256 * 257, np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                for cat, _, start, end in groups(batch.column(0).cast(pa.binary()).to_pylist()):
                    pair = (cat[:-1] & 255).astype(np.int64) * 257 + cat[1:]
                    own = np.zeros(len(cat) + 1, np.int8)
                    own[start] = 1
                    own[end] = -1
                    n += np.bincount(pair[np.cumsum(own[:-1])[1:] > 0], minlength=len(n))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["pair", "n"])

    out = np.zeros(256 * 257, np.int64)
    for r in texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def train(texts: DataFrame) -> Model:
    """texts(text): all are counted."""
    tree = code(symbol_counts(texts))
    shared = texts.sparkSession.sparkContext.broadcast(tree)
    names = ["slice", "data"]

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    place = F.xxhash64("text")
    dealt = texts.select("text", place.alias("place"), F.pmod(place, F.lit(shards)).alias("shard")).repartition("shard").sortWithinPartitions("shard", "place", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for whole in batches:
            for batch in slices(whole, 0):
                shard = batch.column(2).to_numpy()
                cuts = np.flatnonzero(np.diff(shard)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                    if a < b and shard[a] != at:
                        if own is not None:
                            yield from made_by(own, at)
                        own, at = Learner(shared.value), shard[a]
                    own.hold(batch.column(0).slice(a, b - a).cast(pa.binary()).to_pylist())
        if own is not None:
            yield from made_by(own, at)

    def made_by(own: Learner, at: int) -> Iterator[pa.RecordBatch]:
        own.finish()
        yield state_of(own, at)
        yield from packed_counts(own.counts)

    def state_of(own: Learner, at: int) -> pa.RecordBatch:
        state = np.concatenate(([at, own.seen], (own.model.weights * own.seen).ravel(), own.refining.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([state.tobytes()], pa.binary())], names=names)

    def packed_counts(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        flat = counts.reshape(-1, SLICE * 2)
        for i in np.flatnonzero(flat.any(axis=1)):
            planes = b"".join((flat[i] >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([shrink(planes)], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        states: dict[float, np.ndarray] = {}
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i < 0:
                    x = np.frombuffer(data)
                    states[x[0]] = x[1:]
                else:
                    planes = np.frombuffer(grow(data), np.uint8).reshape(4, -1)
                    own = total.setdefault(i, np.zeros(SLICE * 2, np.int64))
                    for k in range(4):
                        if planes[k].any():
                            own += planes[k].astype(np.int64) << (8 * k)
        if states:
            total[-1] = sum(states[k] for k in sorted(states))
        for i, x in total.items():
            made = x.tobytes() if i < 0 else np.round(odds_of(x.reshape(-1, 2)) * STEP).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([made], pa.binary())], names=names)

    packed = dealt.mapInArrow(learn, "slice bigint, data binary")
    model = fresh(tree)
    flat = model.odds.reshape(-1, SLICE)
    for row in packed.repartition("slice").mapInArrow(add, "slice bigint, data binary").toLocalIterator():
        if row["slice"] >= 0:
            flat[row["slice"]] = np.frombuffer(row["data"], np.int8)
            continue
        state = np.frombuffer(row["data"])
        model.weights = (state[1 : 1 + 256 * PREDICTORS] / state[0]).reshape(PREDICTORS, 256).astype(np.float32)
        n, ones = state[1 + 256 * PREDICTORS :].reshape(2, 256, BUCKETS)
        p = (ones + 8 / (1 + np.exp(-model.refined))) / (n + 8)
        model.refined = np.log(p / (1 - p)).astype(np.float32)
    return model


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z lower-cased, and how many words each text has."""
    whole = b" ".join([(t or b"").lower() for t in texts])
    hashes, starts, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(whole):
        end = min(at + GROUP, len(whole))
        while end < len(whole) and not _WHITE[whole[end]]:
            end += 1
        b = np.frombuffer(whole[at:end], np.uint8)
        white = np.concatenate(([True], _WHITE.take(b), [True]))
        edges = np.flatnonzero(white[1:] != white[:-1])
        start, stop = edges[::2], edges[1::2]
        power, inverse = _powers(1 << (GROUP - 1).bit_length()) if len(b) <= GROUP else _powers.__wrapped__(len(b))
        sums = np.concatenate((np.zeros(1, U), np.cumsum((b + U(1)) * power[: len(b)])))
        own = (sums[stop] - sums[start]) * inverse[start]
        hashes.append(mixed(own ^ ((stop - start).astype(U) << U(32))).view(np.int64))
        starts.append(start + at)
        at = end
    ends = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(texts: DataFrame) -> DataFrame:
    """(word, n): hashes of the words of texts(text) with their counts, summed in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, 0):
                held.append(hashed_words(batch.column(0).cast(pa.binary()).to_pylist())[0])
                if (size := size + len(held[-1])) > HELD_WORDS:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_sums(docs: DataFrame, known: DataFrame, hot: tuple[np.ndarray, np.ndarray], ends: int) -> DataFrame:
    """(row, n_tokens, n_known, log) for docs(row, text): tokens, known ones, and the sum of log10(c + 0.1).

    What a text's hot words and its end add is summed where it is read, and sent as a mark, with minus its tokens as
    ``times``; its other words are sent to meet their counts. Rows that are alike in all send the same; their marks
    tell how many they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        table, counts = shared.value
        logs = np.log10(counts + 0.1)
        for whole in batches:
            for batch in slices(whole, 1):
                row_of = batch.column(0).to_numpy()
                word, n = hashed_words(batch.column(1).cast(pa.binary()).to_pylist())
                at = find(table, word)
                rare = at < 0
                row = np.repeat(np.arange(len(n)), n)
                log = np.bincount(row[~rare], logs[at[~rare]], len(n)) + np.log10(ends + 0.1)
                sent = row_of[row[rare]]
                columns = (np.concatenate((sent, row_of)), np.concatenate((word[rare], row_of)), np.concatenate((np.ones(len(sent), np.int64), -1 - n)), np.concatenate((np.zeros(len(sent)), log)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "word", "times", "log"])

    met = docs.mapInArrow(run, "row bigint, word bigint, times bigint, log double").join(known, "word", "left")
    mark, c = F.col("times") < 0, F.coalesce("n", F.lit(0))
    sums = met.groupBy("row").agg(
        F.count_if(mark).alias("copies"),
        F.sum(F.when(mark, -F.col("times")).otherwise(0)).alias("tokens"),
        F.count_if(~mark & (c == 0)).alias("unknown"),
        F.sum(F.when(mark, F.col("log")).otherwise(F.log10(c + 0.1))).alias("log"),
    )
    tokens, unknown = (F.col("tokens") / F.col("copies")).cast("bigint"), (F.col("unknown") / F.col("copies")).cast("bigint")
    return sums.select("row", tokens.alias("n_tokens"), (tokens - unknown - F.lit(int(ends == 0))).alias("n_known"), (F.col("log") / F.col("copies")).alias("log"))


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of x in a sorted table; -1 for those not there."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: whether it is held out, tokens, known tokens, training tokens, base score, score, bits a byte."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    training = rows.filter(trained_on()).select("text")
    vocabulary = cut(words(training))
    ends = training.count()
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    top = vocabulary.filter(F.col("n") > total // HOT_WORDS).toPandas().sort_values("word")  # fewer than HOT_WORDS
    hot = (top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
    model = train(training)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        keep_freed()
        model = replace(shared.value, odds=shared.value.odds.copy())  # numpy asks for large pages for its own arrays

        def score(texts: list[bytes | None]) -> list[pa.Array]:
            made = log_probabilities(model, texts)
            return [pa.array(made), pa.array(-made / np.log10(2) / np.maximum([len(t or b"") for t in texts], 1))]

        return score

    fields = [T.StructField(x, T.DoubleType()) for x in ("score", "bits_per_byte")]
    keyed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    base = word_sums(keyed.select("row", "text"), vocabulary, hot, ends)
    met = map_text(keyed, "text", make, fields, drop=True).join(base, "row")
    norm = F.log10(F.lit(float(total)) + 0.1 * (distinct + 1))
    return met.select(
        "doc_id",
        (~trained_on()).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * norm).alias("base_score"),
        "score",
        "bits_per_byte",
    )
