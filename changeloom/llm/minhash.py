"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates.

Two texts are linked if their sets of 4-word shingles have a Jaccard similarity of 0.8 or more; each link is confirmed on
the full sets. A set's hashes are its one permutation: the highest bits name a bin, the least hash of a bin is its value. An
empty bin takes the value of a full one, in an order of bins that is its own and fixed (optimal densification). A sketch has
a byte a bin; BANDS groups of ROWS bins each name a bucket. At 0.8 a pair shares no bucket once in 16,000 times.

Pairs are bounded by stars. Each text is first tested with a few texts only: of the least ones of its buckets those that it
shares most buckets with. What that links has one label. In a bucket of several labels the texts are dealt to blocks by their
hashes, and each text that isn't of the bucket's largest label visits all its blocks with its full set; a block's sets are
inverted once, so a visit counts its shared shingles with all of them. So no bucket meets in one task, and no pair leaves its
task unless it is a link that joins labels which the task's links before it haven't joined: fewer links than the task has
labels, and what any link between labels connects is connected.

Cases: texts of the same shingles are one node; a text of one to three words is one shingle; texts without words, and null
texts, have an empty set, link with nothing and are their own component; a null doc_id is never the smallest of a
component, its row has the component of its text (null if no other id is in it) and is kept only then; rows that repeat a
doc_id stay rows; repeated shingles count once; a very long text is read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, join_sizes, map_text, pick, small_batches
from changeloom.llm.components import components
from changeloom.llm.similar import verified
from changeloom.llm.simhash import shingles

#: Words of a shingle. The least similarity of a link is that of ``similar``: 4 of 5.
WORDS = 4

#: Bins of a sketch (a power of two), bins of a band, bands.
BINS, ROWS, BANDS = 512, 6, 32

#: The texts that each text is tested with first.
STARS = 3

#: Shingles of a block, about.
BLOCK = 1 << 19

#: A task remembers so many labels that its links have joined; beyond, it starts anew and may join some of them again.
REMEMBERED = 1_000_000

U = np.uint64


def orders(bins: int = BINS) -> np.ndarray:
    """For each bin all bins in an order of its own, the same in every worker."""
    x = np.arange(bins * bins, dtype=U) * U(0x9E3779B97F4A7C15) + U(1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return np.argsort((x ^ (x >> U(31))).reshape(bins, bins), axis=1, kind="stable").astype(np.int32)


def densified(values: np.ndarray, full: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Empty bins get the value of the first full one in their order."""
    there = np.zeros(len(values), bool)
    there[full] = True
    left, start, step = np.flatnonzero(~there), 0, 8
    while len(left):
        tried = order[left, start : start + step]
        hit = there[tried]
        found = hit.any(axis=1)
        values[left[found]] = values[tried[found, hit[found].argmax(axis=1)]]
        left, start, step = left[~found], start + step, 4 * step
    return values


def sketch(own: np.ndarray, order: np.ndarray) -> bytes:
    """A byte a bin for a sorted set of 64-bit hashes that isn't empty."""
    bins = (own >> U(65 - len(order).bit_length())).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    values = np.zeros(len(order), U)
    values[bins[at]] = own[at]
    values = densified(values, bins[at], order) * U(0xD6E8FEB86659FD93)
    return (values >> U(56)).astype(np.uint8).tobytes()


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingles(text, words))


def sketched(docs: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """docs without the text, with its set's digest, size n and sketch (null for an empty set)."""

    def make():
        order = orders()

        def made(texts: list[bytes | None]) -> list[pa.Array]:
            sets = [shingle_set(t, words) for t in texts]
            return [
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([sketch(x, order) if len(x) else None for x in sets], pa.binary()),
            ]

        return made

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return map_text(docs, text, make, fields, drop=True)


def banded(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each band of nodes(node, sketch); the lowest bits of key are the band's number."""
    keys = [F.xxhash64(F.lit(i), F.substring("sketch", ROWS * i + 1, ROWS)).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.lit(i)) for i in range(BANDS)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, center, size): the rows of buckets with several nodes; center is the least one."""
    lists = banded(nodes)
    several = cut(lists.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("size")).filter("size > 1"))
    return join_sizes(lists, several, "key", "size", "node").filter("center IS NOT NULL")


def stars(met: DataFrame, most: int = STARS) -> DataFrame:
    """(a, b): each node and the centres, below it, that it shares most buckets with."""
    votes = met.filter("node <> center").groupBy("node", "center").count()
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "center"))), 1, most)
    return votes.groupBy(F.col("node").alias("a")).agg(best.alias("best")).select("a", F.explode("best.center").alias("b"))


def labelled(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, label): for each node with a link to a smaller one, one that so many doubled steps down those links reach."""
    up = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    for _ in range(jumps):
        further = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
        sizes = up.groupBy("label").agg(F.count("*").alias("size")).join(further, "label", "left")
        up = cut(join_sizes(up, sizes, "label", "size", "node").select("node", F.coalesce("next", "label").alias("label")))
    return up


def dealt(met: DataFrame, labels: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, home, minor, node, label, own) for buckets of several labels.

    Each node is at home in one block of its bucket; nodes of all but the bucket's largest label (minor) visit each block.
    """
    sized = met.join(sets.select("node", F.size("own").alias("n")), "node")
    marked = sized.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("size"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    rest = join_sizes(marked, cut(mixed.select("key", "major", "size", "all")), "key", "size", "node").filter("major IS NOT NULL")
    blocks = F.ceil(F.col("all") / block)
    minor = F.col("label") != F.col("major")
    visits = F.when(minor, F.sequence(F.lit(0).cast("bigint"), blocks - 1)).otherwise(F.array().cast("array<bigint>"))
    places = F.concat(F.array(-1 - F.pmod(F.xxhash64("node"), blocks)), visits)  # the block at home counts from -1 down
    placed = rest.select("key", "node", "label", minor.alias("minor"), F.explode(places).alias("p")).join(sets, "node")
    home = F.col("p") < 0
    return placed.select("key", F.when(home, -1 - F.col("p")).otherwise(F.col("p")).alias("block"), home.alias("home"), "minor", "node", "label", "own")


class Block:
    """The sets at home in a block, inverted: the shingles in order, each with the number of its set."""

    def __init__(self, parts: list[dict]):
        self.minor, self.node, self.label, self.n = (np.concatenate([p[c] for p in parts]) for c in ("minor", "node", "label", "n"))
        flat = np.concatenate([p["own"] for p in parts])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.number = flat[order], np.repeat(np.arange(len(self.n)), self.n)[order]

    def links(self, node: int, label: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each other label one set that is similar enough, and those labels; of two visitors the smaller one asks."""
        low, high = np.searchsorted(self.shingles, own), np.searchsorted(self.shingles, own, side="right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(self.number[at], minlength=len(self.n))
        near = (5 * both >= 4 * (self.n + len(own) - both)) & (self.label != label) & (~self.minor | (self.node > node))
        found = np.flatnonzero(near)
        labels, at = np.unique(self.label[found], return_index=True)
        return self.node[found[at]], labels


class Joined:
    """Labels that links have joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = label = self.above.get(up, up)
        return label

    def join(self, a: int, b: int) -> bool:
        """Whether they weren't joined before."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def linked_in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links between labels of rows (see ``dealt``), so many that they join what all such links join."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, block, joined = None, [], None, Joined()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, number, here, minor, node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            n = batch.column(6).value_lengths().to_numpy()
            own, ends = batch.column(6).flatten().to_numpy(), np.cumsum(n)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (here[1:] != here[:-1])) + 1
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if at != (key[s], number[s]):
                    at, home, block = (key[s], number[s]), [], None
                    if len(joined.above) > REMEMBERED:
                        joined = Joined()
                if here[s]:
                    home.append({"minor": minor[s:e], "node": node[s:e], "label": label[s:e], "n": n[s:e], "own": own[ends[s] - n[s] : ends[e - 1]]})
                elif home:
                    block = block or Block(home)
                    for i in range(s, e):
                        others, labels = block.links(node[i], label[i], own[ends[i] - n[i] : ends[i]])
                        found += [(node[i], other) for other, to in zip(others.tolist(), labels.tolist(), strict=True) if joined.join(int(label[i]), to)]
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["a", "b"])

    ordered = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("home"))
    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id of its component), kept."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    prints = cut(sketched(rows, "text").withColumn("doc_id", F.col("doc_id").cast("bigint")))
    made = prints.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.first("sketch").alias("sketch"))
    nodes = cut(made.withColumn("node", F.monotonically_increasing_id()))
    met = cut(shared_buckets(nodes))
    sets = cut(_sets(rows, nodes.join(met.select("node").distinct(), "node", "left_semi")))
    first = cut(verified(stars(met), sets))
    more = linked_in_blocks(dealt(met.select("key", "node"), labelled(first), sets, block))
    return _named(prints, nodes.drop("sketch"), components(first.unionByName(more)))


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own): the shingle hashes of nodes, read again from one document of each."""

    def make():
        def made(texts: list[bytes | None]) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            return [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]

        return made

    some = nodes.filter("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    texts = rows.join(some, "doc_id", "left_semi").unionByName(rows.filter("doc_id IS NULL")).select("text")
    own = map_text(texts, "text", make, [T.StructField("digest", T.BinaryType()), T.StructField("own", T.ArrayType(T.LongType()))], drop=True)
    return own.join(nodes.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "own")


def _named(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    linked = nodes.join(found, "node").select("node", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_sizes(linked, smallest, "root", "members", "node").select("node", "component_id")
    whole = nodes.join(named, "node", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"), "size")
    spread = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    some = prints.filter("n > 0").select("doc_id", "n", "digest").withColumn("_spread", spread)
    met = join_sizes(some, whole, "digest", "size", "_spread").select("doc_id", "n", "component_id")
    none = prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return met.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
