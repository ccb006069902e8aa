"""How the sources of a language differ in their words: exact shares of all frequent terms, by source.

Terms are counted in tasks by length-bucketed packing: a text's bytes are lower-cased and parted at once by a table; terms of up
to 2, 4, 6 and 8 bytes become one uint64 word, of up to 16 two, and each of these buckets is radix-sorted, 16 bits a pass, in as
many passes as its terms have bytes for. Longer terms are sorted as bytes, in buckets by length. Equal terms then stand
together, in the order of their documents, so runs give counts and documents. Spark adds up what batches find.

Distances of all pairs of sources are sums over terms. Terms are dealt to blocks, and sources to tiles of bounded size; a task
adds up its blocks' differences and gives one row a pair of sources, so neither a language nor a term meets in one task.

Cases: null text, lang and source count as ''; a group without terms has p = 1 + floor(10^9 * 5 / (5 V)); without kept
terms all pairs differ by 0; terms of any length, also in very long texts, count whole; rows count as documents, repeated
ids too; ties are ordered by the bytes of the item; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import cut, join_sizes, pick, slices, small_batches

#: A term counts if it is in so many documents of its language; a share is in parts of ONE, after SMOOTH is added.
LEAST_DOCS, ONE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50

#: Bytes of text that are sorted together.
SORTED_BYTES = 8 << 20

#: Terms of a block and sources of a tile, when pairs of sources are compared; cells of a matrix there.
BLOCK, TILE, CELLS = 4096, 512, 1 << 21

#: The longest terms of each bucket of packed terms, and of terms that are sorted as bytes of a fixed width.
PACKED, WIDE = (2, 4, 6, 8, 16), (32, 64, 128)

U = np.uint64

#: Bytes of terms, A-Z lower-cased; 0 for all others.
TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts with 0 for bytes of no term; each term's start, length and text."""
    low = TABLE[np.frombuffer(b"\n".join(texts) + bytes(max(WIDE)), np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], low != 0))))
    starts, ends = edges[::2], edges[1::2]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return low, starts, ends - starts, np.searchsorted(first, starts, side="right") - 1


def packed(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one word, the first byte highest, zeros after the end."""
    words = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))[starts].astype(U)
    over = U(8) * (U(8) - np.minimum(lengths, 8).astype(U))
    return words >> over << over


def radix_order(words: list[np.ndarray], width: int) -> np.ndarray:
    """The stable order of terms of up to ``width`` bytes by their words, by 16 bits a pass from the last on."""
    order = np.arange(len(words[0]))
    for byte in range((width - 1) // 2 * 2, -1, -2):
        digit = (words[byte // 8] >> U(48 - 8 * (byte % 8))).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(new_term: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of a term and group start among sorted terms; their occurrences and documents."""
    change = np.concatenate(([True], new_term | (group[1:] != group[:-1])))
    at = np.flatnonzero(change)
    new_doc = change | np.concatenate(([True], doc[1:] != doc[:-1]))
    return at, np.diff(np.append(at, len(doc))), np.add.reduceat(new_doc.astype(np.int64), at)


def counted(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Terms with their groups, occurrences and documents, by bucket; groups has each text's group in ascending order."""
    low, starts, lengths, doc = spans(texts)
    least = 0
    for width in PACKED + WIDE:
        at = np.flatnonzero((lengths > least) & (lengths <= width))
        least = width
        if not len(at):
            continue
        s, n = starts[at], lengths[at]
        if width <= 16:
            words = [packed(low, s, n)] + ([packed(low, s + 8, n - 8)] if width > 8 else [])
            order = radix_order(words, width)
            words = [w[order] for w in words]
            new_term = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
            raw = np.stack(words, axis=1).astype(">u8").view(f"S{8 * len(words)}").ravel()
        else:
            cells = np.ndarray((len(low) - width + 1,), f"S{width}", low, strides=(1,))[s].view(np.uint8).reshape(-1, width)
            raw = np.where(np.arange(width) < n[:, None], cells, 0).astype(np.uint8).view(f"S{width}").ravel()
            order = np.argsort(raw, kind="stable")
            raw = raw[order]
            new_term = raw[1:] != raw[:-1]
        d = doc[at][order]
        first, n, docs = runs(new_term, d, groups[d])
        yield raw[first].tolist(), groups[d[first]], n, docs
    rest = sorted((low[starts[i] : starts[i] + lengths[i]].tobytes(), int(doc[i])) for i in np.flatnonzero(lengths > least))
    if rest:
        found = [(term, g, [x[1] for x in own]) for (term, g), own in groupby(rest, lambda x: (x[0], int(groups[x[1]])))]
        yield [f[0] for f in found], np.array([f[1] for f in found]), np.array([len(f[2]) for f in found]), np.array([len({*f[2]}) for f in found])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text): occurrences, and documents with the term."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SORTED_BYTES):
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                known = sorted(set(pairs))
                number = {p: i for i, p in enumerate(known)}
                codes = np.array([number[p] for p in pairs])
                order = np.argsort(codes, kind="stable")
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                for terms, g, n, d in counted([texts[i] for i in order], codes[order]):
                    arrays = [pa.array([p[i] for p in known]).take(pa.array(g)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=names)
        pa.default_memory_pool().release_unused()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact; 0 without terms."""
    above = (n + SMOOTH).cast("decimal(38,0)") * F.lit(ONE).cast("decimal(10,0)")
    below = (total + SMOOTH * terms).cast("decimal(38,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below)).otherwise(F.lit(0).cast("bigint"))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def gaps(shares: list[tuple[str, str, int]], sources: list[str], zero: list[int]) -> np.ndarray:
    """The sums over terms of |p - q| for each two sources (above the diagonal), of shares(term, source, p); zero: the others."""
    number = {s: i for i, s in enumerate(sources)}
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in shares))}
    p = np.repeat(np.array([zero], np.int64), len(terms), axis=0)
    for term, source, own in shares:
        p[terms[term], number[source]] = own
    total = np.zeros((len(sources), len(sources)), np.int64)
    for x in range(len(sources)):
        total[x, x + 1 :] = np.abs(p[:, x + 1 :] - p[:, x : x + 1]).sum(axis=0)
    return total


def distances(shares: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value), a < b: the sum of |p - q| over all kept terms for each two groups of a language.

    shares(lang, source, term, p, terms) has the terms that a group has, groups(lang, source, zero, terms, sources) all groups
    with the share of a term that they don't have, the language's number of kept terms and of sources.
    """
    blocks = F.greatest(F.ceil(F.col("terms") / block), F.lit(1))
    tiles = F.ceil(F.col("sources") / tile)
    own = F.pmod(F.xxhash64("source"), tiles)
    others = F.sequence(F.lit(0).cast("bigint"), tiles - 1).alias("others")
    zeros = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), own.alias("own"), others)
    there = shares.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p", own.alias("own"), others)
    placed = zeros.union(there).withColumn("t", F.explode("others"))
    rows = placed.select("lang", "block", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), "source", "term", "p", "own")
    key = ["lang", "block", "i", "j"]

    def given(sums: dict) -> pa.RecordBatch:
        flat = [(lang, *pair, v) for lang, own in sums.items() for pair, v in own.items()]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds)], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[tuple[str, str], int]] = {}
        entries = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (lang, _, i, j), own in groupby(entries, lambda row: row[:4]):
            if lang not in sums and len(sums) >= 64:  # a task may have many small languages
                yield given(sums)
                sums = {}
            names, zero, tile_of, held, total = [], [], [], [], 0
            for *_, source, term, p, t in own:
                if term is None:
                    names.append(source)
                    zero.append(p)
                    tile_of.append(t)
                    continue
                if len(held) * len(names) >= CELLS and held[-1][0] != term:
                    total, held = total + gaps(held, names, zero), []
                held.append((term, source, p))
            total = total + gaps(held, names, zero)
            mine = sums.setdefault(lang, {})
            for x, y in zip(*np.triu_indices(len(names), 1), strict=True):
                if i == j or tile_of[x] != tile_of[y]:
                    pair = (names[x], names[y])
                    mine[pair] = mine.get(pair, 0) + int(total[x, y])
        yield given(sums)

    dealt = rows.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"), "source")
    parts = dealt.mapInArrow(run, "lang string, a string, b string, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources (part 'pair'), and the terms that a source has
    more of than its language (part 'term', ranks to ``top``)."""
    rows = pick(docs, lang, source, text).toDF("lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(term_counts(rows))
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).filter(F.col("in_docs") >= least_docs).drop("in_docs"))
    found = cut(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    all_groups = rows.select("lang", "source").distinct()
    sources = all_groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = cut(all_groups.join(sources, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total", "size"]))
    met = join_sizes(found.withColumn("key", _pair("lang", "source")).withColumn("_spread", _pair("lang", "term")), groups.withColumn("key", _pair("lang", "source")).drop("lang", "source"), "key", "size", "_spread")
    shares = cut(met.select("lang", "source", "term", "terms", "sources", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")))
    more = ranked(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").filter(F.col("rank") <= top)
    zero = share(F.lit(0), F.col("total"), F.col("terms"))
    apart = distances(shares, groups.select("lang", "source", "terms", "sources", zero.alias("zero")), block, tile)
    both = apart.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    return ranked(both.select("lang", "s.source", "s.item", "value"), "pair").unionByName(more)
