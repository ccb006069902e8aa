"""Removal of word sequences that a document with a smaller id has, by suffix trees partitioned by prefixes.

Words are runs of what isn't white space (space, \\t to \\r). Suffixes are those of the documents' word sequences, cut at
the window's length, at which a tree's deep nodes are sought. A suffix goes to the group that its prefix names: the
least 5-word sequence of the prefix, by hash, or the whole prefix where that sequence has too many suffixes for a group's memory.
Suffixes of one prefix meet in one group, so a group has the whole subtree below it. Suffixes that follow each other
and have the least sequence in common travel as one run of words, which takes about 3 words a suffix instead of 13.

A group builds its subtrees over word ids: it sorts its suffixes by the path of their words, compares neighbours word by word,
and so has the nodes at the window's depth; a node with several documents below it is a repeat. Neighbouring
repeats of a document make its maximal repeats; their words go when the marks are back at the texts.

Words are compared as bytes, never by hash alone: hashes deal suffixes to groups and bring equal ones together, and each
pair of neighbours is then compared.

Before a batch is sent, suffixes that repeat within it are settled there, so that at most one document of a batch
goes to the group for a repeat, however many documents share it.

Cases: a null or empty text has no words; a text of fewer words than a window stays; rows that repeat an id don't
remove each other's words; a null id counts as larger than any other; a very long text is read whole, and runs of it
are dealt like those of others; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import pick, slices, small_batches

WINDOW = 13

#: Words of the sequence whose least one names a suffix's group, and counters of the suffixes that each has.
SHORT, COUNTERS = 3, 1 << 16

#: A group is planned for so many suffixes, about 60 bytes each with their words and what sorting takes.
GROUP = 4_000_000

#: Bytes of text whose suffixes are settled and sent together.
SENT = 16 << 20

#: Bytes of text that are hashed at once.
PART = 1 << 20

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_NO_ID = (1 << 63) - 1

#: Set in the row's number where the id is null.
_NULL = 1 << 31


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, where it begins, and its bytes."""
    out, at = [(np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not _WHITE[text[end]]:
            end += 1
        b = np.frombuffer(text[at:end], np.uint8)
        word = ~_WHITE[b]
        starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
        if len(starts):
            own = np.flatnonzero(word)
            sizes = np.diff(np.append(np.searchsorted(own, starts), len(own)))
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            powers = np.cumprod(np.full(int(sizes.max()), _BASE, U))
            h = np.add.reduceat((b[own].astype(U) + U(1)) * powers[place], np.cumsum(sizes) - sizes)
            out.append((_mixed(h ^ (sizes.astype(U) << U(32))), starts + at, sizes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_hashes(text: bytes) -> np.ndarray:
    return words_of(text)[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of the words, word by word."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def numbered(text: bytes, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal words, and which word of the text is the first of each number.

    Words of one hash are compared byte by byte with the first of them; if any differs, words are told apart as bytes.
    """
    numbers, _ = pd.factorize(hashes.view(np.int64))
    first = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    b, like = np.frombuffer(text, np.uint8), first[numbers]
    again = np.flatnonzero(like != np.arange(len(numbers)))
    alike = bool((sizes[again] == sizes[like[again]]).all())
    for i in range(0, len(again) if alike else 0, PART >> 3):
        part = again[i : i + (PART >> 3)]
        alike &= bool((b[_spread(starts[part], sizes[part])] == b[_spread(starts[like[part]], sizes[part])]).all())
    if not alike:
        numbers, _ = pd.factorize(np.array([text[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)], object))
        first = np.zeros(int(numbers.max()) + 1, np.int64)
        first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return numbers.astype(np.int32), first


@dataclass
class Suffixes:
    """Those of at least a window's words of some texts, in order.

    ``ids`` are the words of all texts, end to end, as numbers; ``first`` is where each suffix begins; word k is
    ``size[k]`` bytes of ``whole`` from ``start[k]``.
    """

    whole: bytes
    start: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    text: np.ndarray
    place: np.ndarray
    first: np.ndarray
    least: np.ndarray  # hash of the least short sequence of the suffix's prefix
    path: np.ndarray  # hash of the whole prefix


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other."""
    out, size = h, 1
    for bit in bin(n)[3:]:
        out, size = out[: len(out) - size] * U(pow(_BASE, size, 1 << 64)) + out[size:], 2 * size
        if bit == "1":
            out, size = out[: len(out) - 1] * U(_BASE) + h[size : size + len(out) - 1], size + 1
    return _mixed(out)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n that follow each other."""
    out, size = h, 1
    while size < n:
        step = min(size, n - size)
        out, size = np.minimum(out[: len(out) - step], out[step:]), size + step
    return out


def suffixes(texts: list[bytes | None], window: int = WINDOW) -> Suffixes:
    whole = b"\n".join([*(t or b"" for t in texts), b""])
    hashes, starts, lengths = words_of(whole)
    ids, known = numbered(whole, hashes, starts, lengths)
    text, place, first = _full(texts, starts, window)
    least, path = (_least(_sums(hashes, min(SHORT, window)), window - min(SHORT, window) + 1)[first], _sums(hashes, window)[first]) if len(first) else (hashes[:0], hashes[:0])
    return Suffixes(whole, starts[known], lengths[known], ids, text[first], place[first], first, least, path)


def _full(texts: list[bytes | None], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each word of the texts laid end to end, its place there, and the words where a whole window begins."""
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    n = np.diff(np.searchsorted(starts, ends), prepend=0)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = (np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    return text, place, np.flatnonzero(place + window <= n[text])


def leasts(texts: list[bytes | None], window: int) -> np.ndarray:
    """What ``suffixes`` gives as ``least``."""
    hashes, starts, _ = words_of(b"\n".join([t or b"" for t in texts]))
    first = _full(texts, starts, window)[2]
    return _least(_sums(hashes, min(SHORT, window)), window - min(SHORT, window) + 1)[first] if len(first) else hashes[:0]


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, each column's as planes of bytes so that bytes that vary little take little."""
    planes = b"".join(np.ascontiguousarray(c.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(planes) // (8 * columns)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes.reshape(columns, 8, n)]


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new).tolist()
    return zip(starts, [*starts[1:], n], strict=False)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that repartition(n, ...) deals to n different partitions, one to each."""
    found = spark.range(0, 40 * n + 1000).select((F.col("id").cast("int")).alias("key")).select("key", F.pmod(F.hash("key"), F.lit(n)).alias("to")).groupBy("to").agg(F.min("key").alias("key"))
    return [r["key"] for r in found.orderBy("to").collect()]


def heavy(docs: DataFrame, window: int, group: int, least_groups: int) -> tuple[int, np.ndarray]:
    """How many groups there are, and the counters of least sequences that are too full for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, SENT):
                least = leasts(batch.column(0).cast(pa.binary()).to_pylist(), window)
                own += np.bincount((least % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(own[there])], names=["counter", "n"])

    counts = docs.select("text").mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    total = int(counts["n"].sum())
    groups = max(least_groups, -(-total // group))
    full = np.zeros(COUNTERS, bool)
    full[counts["counter"][counts["n"] > max(1, total // (4 * groups))].to_numpy(np.int64)] = True
    return groups, full


def prefix_of(own: Suffixes, full: np.ndarray) -> np.ndarray:
    """What names a suffix's group: its prefix's least sequence, or where that is too full the whole prefix."""
    return np.where(full[(own.least % U(COUNTERS)).astype(np.int64)], own.path, own.least)


def nodes(ids: np.ndarray, first: np.ndarray, path: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (their words are ids[first : first + window]) in an order that has equal ones side by side, and where each
    of the nodes at the window's depth begins.

    Suffixes are sorted by the hash of their path and compared word by word with the first of their hash. Those that differ
    from it are sorted by their words themselves.
    """
    order = np.argsort(path, kind="stable")
    if not len(order):
        return order, np.empty(0, bool)
    begins = np.concatenate(([True], path[order[1:]] != path[order[:-1]]))
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(order)))
    rest = np.flatnonzero(~begins)
    head = first[order[np.repeat(starts, sizes)[rest]]]
    own, odd = first[order[rest]], np.zeros(len(rest), bool)
    for k in range(window):
        odd |= ids[own + k] != ids[head + k]
    for start in np.unique(np.repeat(starts, sizes)[rest[odd]]).tolist():
        stop = start + int(sizes[np.searchsorted(starts, start)])
        inner = order[start:stop]
        words = ids[first[inner][:, None] + np.arange(window)]
        by = np.lexsort(words.T[::-1])
        order[start:stop] = inner[by]
        begins[start + 1 : stop] = (words[by[1:]] != words[by[:-1]]).any(axis=1)
    return order, begins


def repeats(order: np.ndarray, begins: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which suffixes (in the order of the nodes) another document with a smaller id has below the same node."""
    if not len(order):
        return np.empty(0, bool)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(order)))
    ids, null = ids[order], rows[order] >= _NULL
    least, all_null = (np.repeat(np.minimum.reduceat(x, starts), sizes) for x in (ids, null))
    return (ids > least) | (null & ~all_null)


def _marks(ids: np.ndarray, rows: np.ndarray, places: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Places of repeats, packed for the part of the texts that each belongs to."""
    to = part_of(ids, rows, parts)
    order = np.lexsort((places, rows, ids, to))
    ids, rows, places, to = (x[order] for x in (ids, rows, places, to))
    for a, b in _runs(to):
        yield int(to[a]), pack(_steps(ids[a:b]), _steps(rows[a:b]), _steps(places[a:b]))


def part_of(ids: np.ndarray, rows: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(ids.astype(U) ^ (rows.astype(U) << U(32))) % U(parts)).astype(np.int64)


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], names=["to", "kind", "data"])


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_runs(own: Suffixes, starts: np.ndarray, counts: np.ndarray, id_of: np.ndarray, row_of: np.ndarray, window: int) -> bytes:
    """Runs of suffixes that follow each other (the first of each, and how many), with their words.

    Words are places in a list of the packet's repeated words, the frequent ones first, so that places are mostly small; a word
    that occurs once has the place 0, and these words follow in the order in which they occur.
    """
    n = counts + window - 1
    at = np.repeat(own.first[starts] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = own.ids[at]
    times = np.bincount(at, minlength=len(own.start))
    used = np.flatnonzero(times > 1)
    used = used[np.argsort(-times[used], kind="stable")]
    rank = np.zeros(len(own.start), np.int32)
    rank[used] = np.arange(1, len(used) + 1, dtype=np.int32)
    used = np.concatenate((used, at[times[at] == 1]))
    texts, number = np.unique(own.text[starts], return_inverse=True)
    spelt = np.frombuffer(own.whole, np.uint8)[_spread(own.start[used], own.size[used] + 1)]
    spelt[np.cumsum(own.size[used] + 1) - 1] = 32
    parts = [spelt.tobytes(), _planes(rank[at]), _planes(counts.astype(np.int32)), _planes(number.astype(np.int32)), _planes(own.place[starts].astype(np.int32)), _planes(id_of[texts]), _planes(row_of[texts])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(p).to_bytes(8, "little") + p for p in parts]))


@dataclass
class Group:
    """The runs that a group has got: suffixes over word ids of the group."""

    window: int

    def __post_init__(self) -> None:
        self.words: list[bytes] = []
        self.n_words = 0
        self.held: list[list[np.ndarray]] = []

    def add(self, data: bytes) -> None:
        whole, parts, at = zstandard.ZstdDecompressor().decompress(data), [], 0
        while at < len(whole):
            n = int.from_bytes(whole[at : at + 8], "little")
            parts.append(whole[at + 8 : at + 8 + n])
            at += 8 + n
        n = parts[0].count(b" ")
        number, at = _whole(parts[3], np.int32), _whole(parts[1], np.int32)
        alone = np.flatnonzero(at == 0)
        at += self.n_words - 1
        at[alone] = np.arange(self.n_words + n - len(alone), self.n_words + n, dtype=np.int32)
        self.words.append(parts[0])
        self.n_words += n
        self.held.append([at, _whole(parts[2], np.int32), _whole(parts[4], np.int32), _whole(parts[5], np.int64)[number], _whole(parts[6], np.int64)[number]])

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, row and place of the suffixes that a document with a smaller id has too."""
        at, counts, place, doc, row = (np.concatenate(x) for x in zip(*self.held, strict=True))
        text = b"".join(self.words)
        self.held, self.words = [], []
        numbers, known = numbered(text, *words_of(text))
        ids = numbers[at]
        n = counts.astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        long = n + self.window - 1
        first = np.repeat(np.cumsum(long) - long, n) + step
        salt = _mixed(np.arange(1, len(known) + 1).astype(U) * U(_BASE))
        order, begins = nodes(ids, first, _sums(salt[ids], self.window)[first], self.window)
        run = np.repeat(np.arange(len(n), dtype=np.int32), n)
        gone = order[repeats(order, begins, doc[run], row[run])]
        of = run[gone]
        return doc[of], row[of], place[of].astype(np.int64) + step[gone]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, and text: the words that stay, joined by one space.

    A word goes if a window that covers it also starts in a document with a smaller id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    number = F.xxhash64("text").bitwiseAND(F.lit(_NULL - 1)).bitwiseOR(F.when(F.col("doc_id").isNull(), F.lit(_NULL)).otherwise(F.lit(0)))
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", number)
    groups, flags = heavy(rows, window, group, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys, shared = np.array(even_keys(spark, groups)), spark.sparkContext.broadcast(flags)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SENT):
                id_of = batch.column(0).fill_null(_NO_ID).to_numpy()
                row_of = batch.column(2).to_numpy()
                own = suffixes(batch.column(1).cast(pa.binary()).to_pylist(), window)
                order, begins = nodes(own.ids, own.first, own.path, window)
                later = np.empty(len(order), bool)
                later[order] = repeats(order, begins, id_of[own.text], row_of[own.text])
                gone, sent = np.flatnonzero(later), np.flatnonzero(~later)
                out = [(int(keys[to]), 1, data) for to, data in _marks(id_of[own.text[gone]], row_of[own.text[gone]], own.place[gone].astype(np.int64), groups)]
                if len(sent):
                    name = prefix_of(own, shared.value)[sent]
                    follows = (np.diff(own.first[sent]) == 1) & (np.diff(own.text[sent]) == 0) & (name[1:] == name[:-1])
                    starts = np.flatnonzero(np.concatenate(([True], ~follows)))
                    counts = np.diff(np.append(starts, len(sent)))
                    to = (_mixed(name[starts] ^ U(_BASE)) % U(groups)).astype(np.int64)
                    by = np.argsort(to, kind="stable")
                    starts, counts, to = sent[starts[by]], counts[by], to[by]
                    out += [(int(keys[to[a]]), 0, packed_runs(own, starts[a:b], counts[a:b], id_of, row_of, window)) for a, b in _runs(to)]
                if out:
                    yield _rows(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Group(window)
        for batch in batches:
            through = []
            for to, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    through.append((to, 1, data))
                else:
                    own.add(data)
            if through:
                yield _rows(through)
        if own.held:
            yield _rows([(int(keys[to]), 1, data) for to, data in _marks(*own.removed(), groups)])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole, 1):
                ids, row = batch.column(0), batch.column(2).to_numpy()
                to = keys[part_of(ids.fill_null(_NO_ID).to_numpy(), row, groups)]
                made = [shrink(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), 2, np.int32)), pa.array(made, pa.binary()), ids, pa.array(row)], names=["to", "kind", "data", "doc_id", "row"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[tuple[int, int], list[np.ndarray]] = {}
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for kind, data, own_id, own_row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if kind == 1:
                    ids, row, place = (np.cumsum(x) for x in unpack(data, 3))
                    for a, b in _runs(ids, row):
                        marks.setdefault((int(ids[a]), int(row[a])), []).append(place[a:b].astype(np.int32))
                    continue
                words = grow(data).split()
                gone = marks.get((_NO_ID if own_id is None else own_id, own_row))
                if gone is None:
                    out.append((own_id, len(words), 0, b" ".join(words)))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.concatenate(gone)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                out.append((own_id, len(words), len(words) - len(left), b" ".join([words[i] for i in left])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    sent = rows.mapInArrow(send, "to int, kind int, data binary")
    marked = sent.repartition(groups, "to").mapInArrow(meet, "to int, kind int, data binary")
    marked = marked.select("*", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("row"))
    whole = rows.mapInArrow(texts, "to int, kind int, data binary, doc_id bigint, row bigint")
    met = marked.unionByName(whole).repartition(groups, "to").sortWithinPartitions("to", "kind")
    return met.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row a document: words, removed words and the digest of what is left."""
    return substring_dedup(docs, doc_id, text, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
