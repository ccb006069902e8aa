"""SimHash near-duplicates: 64-bit fingerprints, linked at 3 or fewer differing bits through an index of byte positions.

Two fingerprints that differ in 3 bits share at least 5 of their 8 bytes at the same positions. The index lists
fingerprints by the bytes at some positions, chosen so that any 5 positions hold one of the choices whole. In each
list the positional bytes that a pair shares are tallied, pairs with 5 or more are retained, and their bits are
compared. A list too long for that is split by more positions, until at most 2**24 fingerprints can be in one.

Only distinct fingerprints are listed, so copies cost nothing; a list gives a star for each of its components, not
its pairs, and the stars are joined to components in Spark.

Cases: null and empty texts and texts of white space have fingerprint 0 and are linked like any others; a text of one
or two words is one shingle; repeated shingles count each time; a null doc_id gets the component of its text but is never
its smallest id; rows that repeat a doc_id stay rows; further columns are ignored; an empty table gives no rows; a very
long text is read whole and its hashes are added up in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, join_sizes, map_text, pick
from changeloom.llm.components import components

BITS, SHARED, SEED, SHINGLE = 3, 5, 42, 3

#: A list of more members is split, or searched by differences instead of pairs.
LONG_LIST = 4096

#: Up to so many fingerprints are listed by 3 bytes, more by 5: lists then stay short by chance.
FEW = 1 << 24

#: Any 5 of 8 positions hold 3 of the first four or 3 of the last four.
THREES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))

#: All differences of 1 to 3 bits.
DIFFERENCES = np.array([sum(1 << b for b in c) for k in range(1, BITS + 1) for c in combinations(range(64), k)], np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle of so many words, in order; fewer words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    h = shingles(text, size)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with the fingerprint as BIGINT (its bits are what counts)."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return map_text(docs, text, make, [T.StructField(out, T.LongType())], drop=True)


def _mask(places: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in places)
    return m - (1 << 64) if m >> 63 else m


def _places(choices: list[tuple[int, ...]]) -> list:
    """The choices' names with the bytes of fp at their positions."""
    return [F.struct(F.lit("".join(map(str, c))).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for c in choices]


def _listed(rows: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """A row (choice, bytes, fp) for each choice of positions."""
    return rows.select("fp", F.explode(F.array(*_places(choices))).alias("e")).select("e.choice", "e.bytes", "fp")


def index(prints: DataFrame, long_list: int = LONG_LIST, few: int = FEW) -> DataFrame:
    """prints(fp), distinct, in lists (choice, bytes)."""
    if prints.count() > few:
        return _listed(prints, FIVES)
    lists = _listed(prints, THREES)
    long = lists.groupBy("choice", "bytes").count().filter(F.col("count") > long_list).select("choice", "bytes", F.lit(True).alias("long"))
    finer = F.coalesce(*[F.when(F.col("choice") == "".join(map(str, three)), F.array(*_places([f for f in FIVES if {*three} <= {*f}]))) for three in THREES])
    own = F.array(F.struct("choice", "bytes"))
    marked = lists.join(long, ["choice", "bytes"], "left")
    return marked.select("fp", F.explode(F.when(F.col("long").isNull(), own).otherwise(finer)).alias("e")).select("e.choice", "e.bytes", "fp")


def stars(fps: np.ndarray, long_list: int = LONG_LIST) -> list[tuple[int, int]]:
    """Links (member, least member of its component) between the distinct fingerprints of one list."""
    if len(fps) > long_list:
        return _stars_by_difference(np.unique(fps))
    left, out = np.unique(fps), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = [root]
        while edge and len(left):
            x = left ^ edge.pop()
            shared = np.count_nonzero(x.view(np.uint8).reshape(-1, 8) == 0, axis=1)
            near = np.flatnonzero(shared >= SHARED)
            near = near[np.bitwise_count(x[near]) <= BITS]
            found = left[near]
            edge += list(found)
            out += [(int(f), int(root)) for f in found]
            left = np.delete(left, near)
    return out


def _stars_by_difference(fps: np.ndarray) -> list[tuple[int, int]]:
    """The same in steps that grow with the list, not with its square: every small difference is looked up."""
    free = np.bitwise_or.reduce(fps ^ fps[0])
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for d in DIFFERENCES[(DIFFERENCES & ~free) == 0]:
            want = fps ^ d
            at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
            there = np.flatnonzero(fps[at] == want)
            np.minimum.at(label, there, label[at[there]])
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return [(int(f), int(fps[k])) for f, k in zip(fps, label, strict=True) if f != fps[k]]


def links(lists: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): links enough to connect all fingerprints that 3 or fewer bits part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        rows: list[tuple[int, int]] = []

        def close() -> None:
            if sum(map(len, held)) > 1:
                rows.extend(stars(np.concatenate(held), long_list))
            held.clear()

        for batch in batches:
            choice = batch.column(0).dictionary_encode()
            codes, names = choice.indices.to_numpy(), choice.dictionary.to_pylist()
            bytes_, fps = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (bytes_[1:] != bytes_[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            first = (names[codes[0]], int(bytes_[0]))
            if first != last:
                close()
            held.append(fps[: ends[0]])
            if len(starts) > 1:
                close()
                inner = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                for i in inner:
                    rows.extend(stars(fps[starts[i] : ends[i]], long_list))
                held.append(fps[starts[-1] :])
            last = (names[codes[-1]], int(bytes_[-1]))
            if rows:
                yield _batch(rows)
                rows = []
        close()
        yield _batch(rows)

    return lists.repartition("choice", "bytes").sortWithinPartitions("choice", "bytes").mapInArrow(run, "a bigint, b bigint")


def _batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_list: int = LONG_LIST, few: int = FEW) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component)."""
    rows = cut(fingerprints(pick(docs, doc_id, text), text).select(F.col(doc_id).alias("doc_id"), "fp"))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    found = components(links(index(groups.select("fp"), long_list, few), long_list))
    linked = groups.join(found, groups["fp"] == found["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_sizes(linked, least, "root", "members", "fp").select("fp", "component_id")
    whole = groups.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "size")
    met = join_sizes(rows.withColumn("_spread", F.xxhash64("doc_id")), whole, "fp", "size", "_spread")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
