"""Near-duplicate texts by the Jaccard similarity of their word shingles, found through SimHash fingerprints.

Two texts are linked if their sets of 5-word shingles have a similarity of 0.8 or more; that is tested on the sets of each
candidate pair. Candidates come from an index of byte positions, as in simhash, of fingerprints with more positions than 8,
because a pair at 0.8 shares only about 27 bytes of 100. The index lists each fingerprint by its bytes at some positions (two
for up to about a million texts); no position is in two lists, and there are as many lists as find MISSED of the pairs at
0.8 too few at most, and more of those above. In each list the bytes that a pair shares at POSITIONS further positions are
tallied, pairs with SHARED or more are retained, and their bits are compared.

In a list each text is tested with the first text so retained. What that leaves unlinked is then tested pair by pair:
each pair in the first list that it shares, if the bytes shared at all positions, and all bits, let it be similar enough. So
a large group of near copies costs one test a text and those of the pairs at about 0.74 or more.

Cases: words are those of simhash; a text of fewer than five words is one shingle; texts of the same shingles are one
node of the graph; null texts and texts of white space have no shingle and are alike; a null doc_id is never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, join_sizes, map_text, pick, slices, small_batches
from changeloom.llm.components import components
from changeloom.llm.simhash import shingles

#: Words of a shingle, and the least similarity of a link as a fraction.
WORDS, LEAST = 5, (4, 5)

#: A bit differs with the angle between two sets as a share of pi: 0.1515 at a similarity of 0.8, where the cosine is 8/9.
DIFFER = 0.1515

#: The share of pairs at 0.8 that no list holds.
MISSED = 0.008

#: Bytes of a list: more for more texts, so that no more than 2 to this power that aren't alike meet in one, about.
LEAST_BYTES, MEETING = 2, 4

#: Candidates share bytes at so many of so many further positions at least; 1 in 1,700 pairs at 0.8 share fewer.
SHARED, POSITIONS = 2, 32

#: They differ in so many of the last 64 bits at most; 1 in 3,000 pairs at 0.8 differ in more.
NEAR = 20

#: Whole fingerprints of a pair at 0.8 differ in more bits, or share fewer bytes, than is let through once in so many
#: standard deviations (1 in 6,000 pairs each). Sets smaller than FEW have more ties than the angle tells, so they are tested whatever their bits.
DEVIATIONS, FEW = 3.6, 32

#: 64-bit words of a whole fingerprint at least: with fewer, more pairs below 0.8 are let through.
LEAST_WORDS = 41

#: A task remembers so many nodes that it has listed.
REMEMBERED = 1_000_000

#: Buckets of up to so many texts are compared together.
SMALL = 32

#: So many pairs are unpacked at a time.
PAIRS = 4096

#: Columns of the bytes at the further positions; the last one has the last 64 bits.
MARKS = [f"m{i}" for i in range(POSITIONS // 8)]
U = np.uint64


def shape(n: int) -> tuple[int, int]:
    """Bits of a list, which are whole bytes, and the number of lists for n texts."""
    bits = 8 * max(LEAST_BYTES, ceil((n.bit_length() - MEETING) / 8))
    return bits, ceil(log(MISSED) / log(1 - (1 - DIFFER) ** bits))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingles(text, WORDS))


def node_of(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), 1), U).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def long_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """The bits (0 or 1) of a SimHash fingerprint of so many times 64 bits."""
    salts = np.arange(1, words + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(own), 255):
        h = _mixed(own[i : i + 255, None] + salts)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (ones * 2 > len(own)).astype(np.uint8)


def words_of(bits: int, lists: int) -> int:
    return max(LEAST_WORDS, ceil(bits * lists / 64) + POSITIONS // 8)


def buckets(made: np.ndarray, bits: int, lists: int) -> np.ndarray:
    band = made[: bits * lists].reshape(lists, bits).astype(U) @ (U(1) << np.arange(bits, dtype=U))
    return _mixed(band + (np.arange(1, lists + 1, dtype=U) << U(48))).view(np.int64)


def most_differing(size: int) -> int:
    """The differing bits of so many that a pair may have."""
    return int(size * DIFFER + DEVIATIONS * sqrt(size * DIFFER * (1 - DIFFER)))


def least_shared(size: int) -> int:
    """The bytes at so many positions that a pair must share."""
    same = (1 - DIFFER) ** 8
    return max(0, int(size * same - DEVIATIONS * sqrt(size * same * (1 - same))))


def keys(own: np.ndarray, bits: int, lists: int) -> tuple[np.ndarray, int]:
    """The bucket of a set in each list, and the last 64 bits."""
    key, marks = placed(own, bits, lists)
    return key, int(marks[-1])


def placed(own: np.ndarray, bits: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a set in each list, and the bytes at the further positions, eight a number."""
    made = long_fingerprint(own, words_of(bits, lists))
    return buckets(made, bits, lists), np.packbits(made[-8 * POSITIONS :]).view(np.int64)


def retained(marks: np.ndarray, n: np.ndarray, other: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Whether sets share bytes at enough of the further positions, and are then near by their bits and sizes."""
    tally = np.count_nonzero((marks ^ other).view(np.uint8) == 0, axis=1)
    out = tally >= SHARED
    at = np.flatnonzero(out)
    last, last_n = np.broadcast_to(other[..., -1], out.shape), np.broadcast_to(other_n, out.shape)
    out[at] = near(marks[at, -1], n[at], last[at], last_n[at])
    return out


def near(fp: np.ndarray, n: np.ndarray, other_fp: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Whether sets with these bits and sizes may be similar enough."""
    low, high = np.minimum(n, other_n), np.maximum(n, other_n)
    return (np.bitwise_count((fp ^ other_fp).view(U)) <= NEAR) & (LEAST[1] * low >= LEAST[0] * high)


def listed(docs: DataFrame, text: str, bits: int, lists: int) -> DataFrame:
    """(key, node, n, m0, m1, m2, m3): each set in its bucket of each list, once a task at least."""
    small_batches(docs.sparkSession)
    names = ["key", "node", "n", *MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                rows = []
                for t in batch.column(0).cast(pa.binary()).to_pylist():
                    own = shingle_set(t)
                    if not len(own) or (node := node_of(own)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    rows.append((*placed(own, bits, lists), node, len(own)))
                if rows:
                    key, marks = np.concatenate([r[0] for r in rows]), np.stack([r[1] for r in rows])
                    rest = [np.repeat(np.array(x, np.int64), lists) for x in ([r[2] for r in rows], [r[3] for r in rows], *marks.T)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *rest)], names=names)

    return docs.select(text).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut where it changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(own[0]):
            continue
        start = int(np.searchsorted(own[0], own[0][-1]))
        if held and held[-1][0][-1] != own[0][-1] or start:
            yield [np.concatenate(c) for c in zip(*held, [x[:start] for x in own], strict=True)]
            held = []
        held.append([x[start:] for x in own])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate((np.zeros(1, np.int64), cuts)), np.concatenate((cuts, np.array([len(key)])))


def _worth(key: np.ndarray, node: np.ndarray, marks: np.ndarray, n: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The buckets with candidates: all long ones, and of the others those with two sets retained."""
    sizes = ends - starts
    bucket = np.repeat(np.arange(len(starts)), sizes)
    out = sizes > SMALL
    at = np.flatnonzero((sizes[bucket] > 1) & ~out[bucket])
    for k in range(1, SMALL):
        at = at[at + k < len(key)]
        at = at[bucket[at] == bucket[at + k]]
        if not len(at):
            break
        found = at[(node[at] != node[at + k]) & retained(marks[at], n[at], marks[at + k], n[at + k])]
        out[bucket[found]] = True
    return np.flatnonzero(out)


def candidates(lists: DataFrame) -> DataFrame:
    """(key, node, fp, n, first): the sets of each bucket that are retained with another one there, and the first one with each."""
    names = ["key", "node", "fp", "n", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, *columns in whole_buckets(batches):
            if not len(key):
                continue
            marks, fp = np.stack(columns, axis=1), columns[-1]
            starts, ends = _bounds(key)
            for i in _worth(key, node, marks, n, starts, ends):
                _, at = np.unique(node[starts[i] : ends[i]], return_index=True)
                at += starts[i]
                first, left = np.full(len(at), -1), np.arange(len(at))
                alike = np.zeros(len(at), bool)
                while len(left):
                    root = left[0]
                    close = retained(marks[at], n[at], marks[at[root]], n[at[root]])
                    close[root] = False
                    alike |= close
                    alike[root] |= close.any()
                    first[close & (first < 0)] = root
                    left = left[1:][~close[left[1:]]]
                first = np.where(first < 0, np.arange(len(at)), first)
                own = at[alike]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[own], node[own], fp[own], n[own], node[at[first[alike]]])], names=names)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, node bigint, fp bigint, n bigint, first bigint")


def unlinked(rows: DataFrame, bits: int, lists: int) -> DataFrame:
    """(a, b): pairs that share enough bytes and bits in a bucket of rows(key, node, fp, n, label, whole) whose labels differ, each once: in
    the bucket of the first list that both share."""

    def pairs(key: int, node: np.ndarray, fp: np.ndarray, n: np.ndarray, label: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number = np.flatnonzero(buckets(np.unpackbits(whole[0]), bits, lists) == key)[0]
        most, least = most_differing(8 * whole.shape[1]), least_shared(whole.shape[1])
        for i in range(len(node) - 1):
            met = np.flatnonzero(near(fp[i + 1 :], n[i + 1 :], fp[i], n[i]) & (label[i + 1 :] != label[i])) + i + 1
            for part in np.split(met, range(PAIRS, len(met), PAIRS)):
                other = whole[part] ^ whole[i]
                tally = np.count_nonzero(other == 0, axis=1)
                ok = (tally >= least) & (np.bitwise_count(other).sum(axis=1, dtype=np.int64) <= most) | (np.minimum(n[part], n[i]) < FEW)
                part, other = part[ok], other[ok]
                shared = ~np.unpackbits(other, axis=1, count=bits * lists).reshape(len(part), lists, bits).any(axis=2)
                part = part[shared.argmax(axis=1) == number]
                if len(part):
                    yield np.minimum(node[i], node[part]), np.maximum(node[i], node[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp, n, label, packed in whole_buckets(batches):
            if not len(key):
                continue
            for s, e in zip(*_bounds(key), strict=True):
                whole = np.frombuffer(b"".join(packed[s:e]), np.uint8).reshape(e - s, -1)
                for a, b in pairs(key[s], node[s:e], fp[s:e], n[s:e], label[s:e], whole):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select("key", "node", "fp", "n", "label", "whole").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets(node, own) are similar enough; b may be in most of the pairs."""
    of_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    many = pairs.groupBy("b").agg(F.count("*").alias("size")).join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    met = join_sizes(of_a, many, "b", "size", "a")
    both = F.size(F.array_intersect("own_a", "own_b"))
    return met.filter(both * LEAST[1] >= (F.size("own_a") + F.size("own_b") - both) * LEAST[0]).select("a", "b")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, component_id (the smallest doc_id of its component)."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")

    def nodes():
        return lambda texts: [pa.array([node_of(shingle_set(t)) for t in texts], pa.int64())]

    def own_sets():
        def made(texts: list[bytes | None]) -> list[pa.Array]:
            own = [shingle_set(t) for t in texts]
            whole = [np.packbits(long_fingerprint(x, words_of(bits, lists))).tobytes() for x in own]
            return [pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), pa.array(whole, pa.binary())]

        return made

    named = cut(map_text(rows, "text", nodes, [T.StructField("node", T.LongType())], drop=True))
    groups = cut(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    bits, lists = shape(groups.count())
    found = cut(candidates(listed(rows, "text", bits, lists)))
    met = found.select("node").distinct()
    both = [T.StructField("node", T.LongType()), T.StructField("own", T.ArrayType(T.LongType())), T.StructField("whole", T.BinaryType())]
    # one document stands for those of the same node
    some = groups.join(met, "node", "left_semi").filter("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    texts = rows.join(some, "doc_id", "left_semi").unionByName(rows.filter("doc_id IS NULL")).select("text")
    sets = cut(map_text(texts, "text", own_sets, both, drop=True).join(met, "node", "left_semi").dropDuplicates(["node"]))
    first = found.filter("node <> first").groupBy(F.col("node").alias("a")).agg(F.min("first").alias("b"))
    links = cut(verified(first, sets))
    labels = components(links)
    marked = found.join(labels, "node", "left").select("key", "node", "fp", "n", F.coalesce("root", "node").alias("label"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("key")
    rest = marked.join(mixed, "key", "left_semi").join(sets.select("node", "whole"), "node")
    rest = cut(verified(cut(unlinked(rest, bits, lists)), sets))
    linked = groups.join(components(links.unionByName(rest)), "node").select("node", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    whole = groups.join(join_sizes(linked, smallest, "root", "members", "node").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), "size")
    return join_sizes(named.withColumn("_spread", F.xxhash64("doc_id")), whole, "node", "size", "_spread").select("doc_id", "component_id")
