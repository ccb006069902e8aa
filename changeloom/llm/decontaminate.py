"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows scans each text once.

Texts and items are normalised alike: A-Z are lower-cased, words are runs of digits, letters and all that is not
ASCII, and words are parted by one space. The automaton works on the normalised UTF-8 bytes; what it finds is mapped
back to words and to character offsets of the original text.

Cases: null or empty texts have no words and no hits; items without words have no window; an item shorter than the
window is one window; items that repeat an id count once, an item with a null id marks words but isn't named; windows
that several items share count for each; further columns stay, but for those with the name of a result, which are
replaced; rows that repeat are marked alike; a very long text is scanned whole; empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, held, map_text, once, pick, slices

#: So many windows make one automaton (about 100 bytes a character of a window at most). A larger benchmark takes
#: several automata, each with its own pass over the texts, so that neither driver nor workers hold more than one.
BLOCK_WINDOWS = 100_000

#: Word bytes stay, with A-Z as a-z; all others become spaces.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]
SPANS = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def blocks(items: DataFrame, item_id: str, text: str, size: int, limit: int) -> Iterator[list[tuple[str, int, list[str]]]]:
    """Lists of at most ``limit`` windows: the window, its words, the ids of its items. One list at a time is held."""
    found: dict[bytes, set] = defaultdict(set)
    for row in pick(items, item_id, text).toLocalIterator():
        words = words_of((row[1] or "").encode())
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found[b" ".join(words[i : i + size])].add(row[0])
            if len(found) >= limit:
                yield _listed(found)
                found = defaultdict(set)
    if found:
        yield _listed(found)


def _listed(found: dict[bytes, set]) -> list[tuple[str, int, list[str]]]:
    return [(f" {w.decode('latin-1')} ", w.count(b" ") + 1, sorted({str(x) for x in ids if x is not None})) for w, ids in found.items()]


def automaton(windows: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    """Over the bytes of normalised texts, each as one character; a window's value is its words and items."""
    out = ahocorasick.Automaton()
    for window, n, ids in windows:
        out.add_word(window, (n, ids))
    out.make_automaton()
    return out


def scan(text: bytes | None, found: ahocorasick.Automaton | None) -> tuple[int, np.ndarray | None, set[str]]:
    """The number of words, which of them are hit (None: none), and the items that hit them."""
    words = words_of(text)
    if not words or not found:
        return len(words), None, set()
    hits = list(found.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not hits:
        return len(words), None, set()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(ends, [e for e, _ in hits])
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last + 1, -1)
    np.add.at(marks, last + 1 - np.array([n for _, (n, _) in hits]), 1)
    return len(words), np.cumsum(marks[:-1]) > 0, {i for _, (_, ids) in hits for i in ids}


def spans_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words (hit: their sorted positions) as character offsets of the text as it came."""
    at = [m.span() for m in WORD.finditer(text.decode())]
    first = np.concatenate(([True], np.diff(hit) > 1))
    last = np.concatenate((first[1:], [True]))
    return [{"start": at[a][0], "end": at[b][1]} for a, b in zip(hit[first], hit[last], strict=True)]


def _pass(docs: DataFrame, text: str, windows: list[tuple[str, int, list[str]]]) -> DataFrame:
    """One block's windows marked in docs."""
    shared, key = docs.sparkSession.sparkContext.broadcast(windows), uuid4().hex

    def make():
        found = once(key, lambda: automaton(shared.value) if shared.value else None)

        def mark(texts: list[bytes | None]) -> list[pa.Array]:
            n, hits, ids = [], [], []
            for t in texts:
                k, hit, items = scan(t, found)
                n.append(k)
                hits.append([] if hit is None else np.flatnonzero(hit).astype(np.int32))
                ids.append(sorted(items))
            return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))]

        return mark

    return map_text(docs, text, make, FIELDS)


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs(text, hit_words) with the runs of hit words as passages of the text."""
    at, hits = docs.columns.index(text), docs.columns.index("hit_words")
    schema = T.StructType([*docs.schema.fields, SPANS])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                made = [spans_of(t, np.array(h)) if h else [] for t, h in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(hits).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """docs(held, text) with the number of words, the positions of hit words and their items, from one pass a block."""
    out = None
    for windows in blocks(items, item_id, item_text, size, limit):
        if out is None:
            out = _pass(docs, text, windows)
            continue
        before = F.struct("held", F.col("hit_words").alias("words"), F.col("item_ids").alias("items")).alias("held")
        both = _pass(cut(out.select(before, text)), text, windows)
        out = both.select(
            F.col("held.held").alias("held"),
            text,
            "n_words",
            F.array_sort(F.array_union("held.words", "hit_words")).alias("hit_words"),
            F.array_sort(F.array_union("held.items", "item_ids")).alias("item_ids"),
        )
    return out if out is not None else _pass(docs, text, [])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with the number of words, the positions of the hit ones, their items' ids (sorted as strings) and the
    hit passages as character offsets [start, end) of the text. Columns of these names are replaced.
    """
    found = with_spans(marked(held(docs, text), items, text, item_id, item_text, size, limit), text)
    new = [f.name for f in [*FIELDS, SPANS]]
    own = docs.columns.index(text)
    return found.select(*[(F.col(text) if i == own else F.col(f"held._{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in new], *new)


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 10, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """A row a document: words, hit words, items and their digest."""
    return marked(held(pick(docs, doc_id, text), text), items, text, size=size, limit=limit).select(
        F.col("held._0").alias(doc_id),
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
