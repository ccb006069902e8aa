"""Removal of lines that many documents have, by a sharded minimal perfect hash that documents probe.

Lines are parted at \\n. A line's key is the line without white space (space, \\t to \\r) at its ends and with A-Z
lower-cased; keys are compared by their 128-bit hash. Documents that have a key are counted in Spark; the keys of
enough documents are built into shards, one task a shard, and documents probe the shards' arrays. No line is joined.

Cases: a null text is one empty line and stays null; empty keys are never removed; a key that a document repeats counts
once for it; rows that repeat a doc_id are documents of their own; a very long text is read whole, a line of it may be the
whole text; further columns stay as they are, but for n_lines and n_dropped, which are replaced; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, map_text, once, pick, slices, small_batches
from changeloom.llm.perfect_hash import Index, build

#: Keys in a shard, about.
SHARD_KEYS = 1 << 17

#: Shards of so many bytes at most are broadcast at once; if all take more, documents are read in several passes.
BLOCK_BYTES = 64 << 20


def hashes(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The lines of each text, and a row (a, b) for each line's key; empty keys are (0, 0)."""
    lines = [(t or b"").split(b"\n") for t in texts]
    digest, empty = xxhash.xxh3_128_digest, bytes(16)
    keys = b"".join([digest(k) if (k := x.strip().lower()) else empty for own in lines for x in own])
    return lines, np.fromiter(map(len, lines), np.int64, len(lines)), np.frombuffer(keys, np.uint64).reshape(-1, 2)


def frequent(docs: DataFrame, text: str, min_docs: int) -> DataFrame:
    """The keys (a, b) of at least min_docs rows, with that number. Counts are summed in each batch before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 0):
                _, n, keys = hashes(batch.column(0).cast(pa.binary()).to_pylist())
                rows = np.empty(len(keys), [("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
                rows["a"], rows["b"], rows["doc"] = keys[:, 0], keys[:, 1], np.repeat(np.arange(len(n)), n)
                rows = np.unique(rows[(rows["a"] != 0) | (rows["b"] != 0)])
                pairs, counts = np.unique(rows[["a", "b"]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[x].astype(np.int64)) for x in "ab"] + [pa.array(counts.astype(np.int64))], names=["a", "b", "n"])

    counted = pick(docs, text).mapInArrow(run, "a bigint, b bigint, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)


def shards(keys: DataFrame) -> tuple[DataFrame, int]:
    """A row for each shard: its number and its pickled arrays; and the number of top bits that give the shard."""
    keys = cut(keys)
    top = max(0, int(np.ceil(np.log2(max(1, keys.count()) / SHARD_KEYS))))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["shard"].iloc[0])
        made = build(number, rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64), rows["n"].to_numpy())
        return pd.DataFrame({"shard": [number], "arrays": [pickle.dumps(made)]})

    shard = F.shiftrightunsigned("a", 64 - top) if top else F.lit(0).cast("bigint")
    return cut(keys.withColumn("shard", shard).groupBy("shard").applyInPandas(one, "shard bigint, arrays binary")), top


def _pass(docs: DataFrame, text: str, held: list[bytes], top: int, min_docs: int) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(held), uuid4().hex

    def make():
        index = once(key, lambda: Index([pickle.loads(x) for x in shared.value], top))

        def keep(texts: list[bytes | None]) -> list[pa.Array]:
            lines, n, keys = hashes(texts)
            stay = index.count(keys[:, 0], keys[:, 1]) < min_docs
            ends = np.cumsum(n)
            lost = np.add.reduceat(~stay, ends - n, dtype=np.int64) if len(n) else n
            out = [t if not k else b"\n".join([x for x, s in zip(own, stay[e - len(own) : e], strict=True) if s]) for t, own, e, k in zip(texts, lines, ends, lost, strict=True)]
            return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(n), pa.array(lost)]

        return keep

    return map_text(docs, text, make, [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def blocks(made: DataFrame, limit: int) -> Iterator[list[bytes]]:
    """Lists of shards of at most ``limit`` bytes together (or one shard), one list at a time."""
    block, size = [], 0
    for row in made.select("arrays").toLocalIterator():
        if block and size + len(row[0]) > limit:
            yield block
            block, size = [], 0
        block.append(bytes(row[0]))
        size += len(row[0])
    yield block


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the lines whose key at least min_docs rows have; n_lines before, n_dropped of them.

    Columns of these names are replaced. Shards beyond block_bytes are probed in several passes, each with what the
    last has left; the lines that go are settled before the first.
    """
    made, top = shards(frequent(docs, text, min_docs))
    out = None
    for held in blocks(made, block_bytes):
        if out is None:
            out = _pass(docs, text, held, top, min_docs)
        else:
            out = _pass(cut(out).withColumn("_before", F.struct("n_lines", "n_dropped")), text, held, top, min_docs)
            out = out.select(*[c for c in out.columns if c not in ("n_lines", "n_dropped", "_before")], "_before.n_lines", (F.col("_before.n_dropped") + F.col("n_dropped")).alias("n_dropped"))
    return out


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """A row a document: lines, dropped lines and the digest of the text that is left."""
    return line_dedup(pick(docs, doc_id, text), text, min_docs).select(doc_id, "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))
