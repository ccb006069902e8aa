"""Labels carried along edges in blocks: how many nodes lead to each label, without a row for each label and node.

Edges are range-dealt by their source and packed into blocks of neighbouring sources. A block gets the labels of each target that it
names once, however many of its edges lead there; its sources' sets are made and tallied in its task, and only tallies leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.session import cut

#: Edges a block, if no source has more; paths whose labels are sorted at once.
EDGES, PATHS = 1 << 20, 1 << 22


def packed(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(block, srcs, degrees, dsts, ends): edges(src, dst) without copies and loops; a source is in one block, with as many ends as
    its degree, which are places in dsts. A block has ``most`` edges, or all of one source."""
    kind = edges.schema["dst"].dataType.simpleString()
    rows = edges.select("src", "dst").filter("src <> dst").repartitionByRange("src").sortWithinPartitions("src", "dst")
    return cut(rows.mapInArrow(lambda x: _pack(x, most), f"block bigint, srcs array<{kind}>, degrees array<int>, dsts array<{kind}>, ends array<int>"))


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, rows, wanted, number = [], 0, most, TaskContext.get().partitionId() << 32
    for b in chain((x.slice(i, most) for x in batches for i in range(0, x.num_rows, most)), [None]):
        if b is not None:
            held.append(b)
            rows += b.num_rows
            if rows < wanted:
                continue
        if not rows:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        src, dst = (pa.concat_arrays(whole[c].chunks).dictionary_encode() for c in ("src", "dst"))
        s, d = (x.indices.to_numpy() for x in (src, dst))
        upto = rows if b is None else int(np.searchsorted(s, s[-1]))  # the last source may go on in the next batch
        if upto:
            s, d = s[:upto], d[:upto]
            new = np.ones(upto, bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d = s[new], d[new]
            at, ends = np.unique(d, return_inverse=True)
            lists = src.dictionary[: int(s[-1]) + 1], np.bincount(s).astype(np.int32), dst.dictionary.take(pa.array(at)), ends.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([number]), *map(_list, lists)], ["block", "srcs", "degrees", "dsts", "ends"])
            number += 1
        held = whole.slice(upto).to_batches()
        rows -= upto
        wanted = max(most, 2 * rows)


def _list(values) -> pa.Array:
    """One list of all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _lines(codes: np.ndarray, start: np.ndarray, size: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of rows gathered by the rows' codes: their places, and each code's first place and number of places."""
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, size, many).astype(np.int64)
    return _ranges(start[order], size[order]), np.cumsum(sizes) - sizes, sizes


class _Block:
    """A block's edges with what was sent to it: kind 0, labels of its targets; 1, labels that its sources have; 2, its sources' values;
    3, sources that aren't counted."""

    def __init__(self, edges: pa.Table, sent: pa.Table, core: bool):
        self.srcs, degrees, dsts, ends = (_one(edges[c]).flatten() for c in ("srcs", "degrees", "dsts", "ends"))
        degrees, ends = degrees.to_numpy(), ends.to_numpy()
        sent = sent.combine_chunks()
        kind, node, ids = sent["kind"].to_numpy(), _one(sent["node"]), _one(sent["ids"])
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, labels = np.cumsum(size) - size, ids.flatten().dictionary_encode()
        self.labels, codes = labels.dictionary, labels.indices.to_numpy().astype(np.int64)
        self.many = max(len(self.labels), 1)
        of, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        place = lambda rows, among: pc.index_in(node.take(pa.array(rows)), among).to_numpy(zero_copy_only=False).astype(np.int64)
        at, self.first, self.size = _lines(place(of, dsts), start[of], size[of], len(dsts))
        self.flat = codes[at]
        own_src = place(own, self.srcs)
        self.own = _distinct(np.repeat(own_src, size[own]) * self.many + codes[_ranges(start[own], size[own])])
        src = np.repeat(np.arange(len(self.srcs)), degrees)
        keep = self.size[ends] > 0
        if core:
            keep &= np.isin(np.arange(len(self.srcs)), own_src)[src]
        if (kind == 3).any():
            keep &= ~np.isin(np.arange(len(self.srcs)), place(np.flatnonzero(kind == 3), self.srcs))[src]
        self.src, self.ends = src[keep], ends[keep]
        valued = np.flatnonzero(kind == 2)
        self.values = (place(valued, self.srcs), _one(sent["values"]).take(pa.array(valued))) if "values" in sent.column_names else None

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sources, labels) by number, each pair once, by source: what its targets have and it doesn't."""
        upto = np.cumsum(self.size[self.ends])
        i, carried = 0, np.empty(0, np.int64)
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PATHS, "right")))
            size = self.size[self.ends[i:j]]
            keys = np.repeat(self.src[i:j], size) * self.many + self.flat[_ranges(self.first[self.ends[i:j]], size)]
            keys = _distinct(np.concatenate([carried, keys]))
            done = len(keys) if j == len(upto) else int(np.searchsorted(keys, self.src[j - 1] * self.many))
            keys, carried = keys[:done], keys[done:]
            if len(self.own):
                keys = keys[self.own[np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)] != keys]
            if len(keys):
                yield keys // self.many, keys % self.many
            i = j


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _sets(sent: pa.Table, edges: pa.Table, names: list[str]) -> pa.Table:
    """(node, ids) of a block: the labels that are new to its sources."""
    made = []
    if sent.num_rows and edges.num_rows:
        block = _Block(edges, sent, True)
        for s, label in block.found():
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[at, len(s)].astype(np.int32)), block.labels.take(pa.array(label)))
            made.append(pa.table([block.srcs.take(pa.array(s[at])), ids], names))
    return pa.concat_tables(made) if made else pa.table([sent["node"].slice(0, 0), sent["ids"].slice(0, 0)], names)


def _tallies(sent: pa.Table, edges: pa.Table, columns: list[str]) -> pa.Table:
    """(sid, of, value, n) of a block: how many sources lead to a label, and of them how many have each value of each column."""
    made, names = [], ["sid", "of", "value", "n"]

    def add(labels, of, values, n):
        made.append(pa.table([labels, pa.array([of] * len(n), pa.string()), values, pa.array(n.astype(np.int64))], names))

    if sent.num_rows and edges.num_rows:
        block = _Block(edges, sent, False)
        total = np.zeros(block.many, np.int64)
        has, lines, held = None, [], {}
        if columns:
            codes, rows = block.values
            has = np.isin(np.arange(len(block.srcs)), codes)
            for k, name in enumerate(columns):
                values = pc.list_element(rows, k) if len(rows) else pa.array([], pa.string())
                full = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
                enc = values.take(pa.array(full)).dictionary_encode()
                many = max(len(enc.dictionary), 1)
                pairs = _distinct(codes[full] * many + enc.indices.to_numpy())
                size = np.bincount(pairs // many, minlength=len(block.srcs)).astype(np.int64)
                lines.append((name, enc.dictionary, many, pairs % many, np.cumsum(size) - size, size))

        def flush(name, words, many):
            keys, n = np.unique(np.concatenate([x for x, _ in held[name]]), return_inverse=True)
            n = np.bincount(n, np.concatenate([x for _, x in held[name]]), len(keys))
            held[name] = [(keys, n)]
            return keys, n

        for s, label in block.found():
            if has is not None:
                s, label = s[has[s]], label[has[s]]
            total += np.bincount(label, minlength=block.many)
            for name, words, many, flat, first, size in lines:
                keys, n = np.unique(np.repeat(label, size[s]) * many + flat[_ranges(first[s], size[s])], return_counts=True)
                held.setdefault(name, []).append((keys, n))
                if sum(len(x) for x, _ in held[name]) > PATHS:
                    keys, n = flush(name, words, many)
                    if 2 * len(keys) > PATHS:
                        add(block.labels.take(pa.array(keys // many)), name, words.take(pa.array(keys % many)), n)
                        held[name] = []
        some = np.flatnonzero(total)
        add(block.labels.take(pa.array(some)), "", pa.nulls(len(some), pa.string()), total[some])
        for name, words, many, *_ in lines:
            if held.get(name):
                keys, n = flush(name, words, many)
                add(block.labels.take(pa.array(keys // many)), name, words.take(pa.array(keys % many)), n)
    return pa.concat_tables(made) if made else pa.table([sent["node"].slice(0, 0).cast(sent.schema.field("ids").type.value_type), *(pa.array([], t) for t in (pa.string(), pa.string(), pa.int64()))], names)


def _met(blocks: DataFrame, sent: DataFrame, sizes: DataFrame, f, schema: str, words: int) -> DataFrame:
    """Blocks with what is sent to them. Where that is more than 4096 x words labels, the labels are dealt to slices, each with the
    block's edges. One row of sizes(block, n) a block is broadcast."""
    slices = F.broadcast(sizes.groupBy("block").agg(F.ceil(F.sum("n") / (4096 * words)).cast("int").alias("_n")))
    each = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    rows = sent.join(slices, "block").select(*sent.columns, "_n", each.alias("slice"))
    ids = F.when(F.col("_n") == 1, F.col("ids")).otherwise(F.filter("ids", lambda x: F.pmod(F.xxhash64(x), F.col("_n")) == F.col("slice")))
    rows = rows.withColumn("ids", ids).drop("_n")
    edges = blocks.join(slices, "block").select(F.col("block").alias("_block"), each.alias("_slice"), *blocks.columns[1:])
    return rows.groupBy("block", "slice").cogroup(edges.groupBy("_block", "_slice")).applyInArrow(f, schema)


def reached_by(blocks: DataFrame, marks: DataFrame | None = None, values: DataFrame | None = None, hops: int | None = None, clear: DataFrame | None = None, words: int = 1024) -> DataFrame:
    """(sid, of, value, n): how many nodes lead to a label sid of marks(sid, node) along the edges of packed(), with of = '', and for each
    column of values(node, ...) how many of them have each value, as text. Without marks each target is its own label.

    At most so many hops count. A node's own labels don't count for it. With values only their nodes count. With clear(node) only these
    nodes pass on what they lead to, and don't count. Nodes that nothing leads to keep no set; those of others are lists, which
    grow round by round by what is new. A task holds 4096 x words labels of targets and the edges of one block.
    """
    node, ends = blocks.schema["dsts"].dataType.elementType.simpleString(), blocks.select("block", F.explode("dsts").alias("node"))
    homes = blocks.select("block", F.explode("srcs").alias("node"))
    targets = ends.select("node").distinct()
    first = cut(targets.select("node", F.array("node").alias("ids")) if marks is None else marks.filter("node IS NOT NULL AND sid IS NOT NULL").groupBy("node").agg(F.collect_set("sid").alias("ids")))
    core = cut(homes.join(targets if clear is None else targets.join(clear.select("node").distinct(), "node", "left_semi"), "node", "left_semi"))
    sent = lambda of, rows, kind: of.join(rows, "node").select("block", F.lit(kind).alias("kind"), "node", "ids")
    sizes = lambda rows: ends.join(rows.select("node", F.size("ids").alias("n")), "node").select("block", "n")
    label = first.schema["ids"].dataType.elementType.simpleString()
    seen = fresh = first
    hop = 1
    while hops is None or hop < hops:
        had = core.join(seen, "node", "left").select("block", F.lit(1).alias("kind"), "node", F.coalesce("ids", F.array().cast(f"array<{label}>")).alias("ids"))
        fresh = cut(_met(blocks, sent(ends, fresh, 0).unionByName(had), sizes(fresh), lambda x, y: _sets(x, y, ["node", "ids"]), f"node {node}, ids array<{label}>", words), measured=True)
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        seen = seen if hop % 8 else cut(seen, measured=True)
        hop += 1
    every = sent(ends, seen, 0).unionByName(sent(homes, first, 1))
    columns = [] if values is None else [c for c in values.columns if c != "node"]
    if clear is not None:
        every = every.unionByName(homes.join(clear.select("node").distinct(), "node", "left_semi").select("block", F.lit(3).alias("kind"), "node", F.lit(None).cast(f"array<{label}>").alias("ids")))
    if columns:
        texts = homes.join(values, "node").select("block", F.lit(2).alias("kind"), "node", F.lit(None).cast(f"array<{label}>").alias("ids"), F.array(*[F.col(c).cast("string") for c in columns]).alias("values"))
        every = every.withColumn("values", F.lit(None).cast("array<string>")).unionByName(texts)
    made = _met(blocks, every, sizes(seen), lambda x, y: _tallies(x, y, columns), f"sid {label}, of string, value string, n bigint", words)
    return made.repartition("sid").groupBy("sid", "of", "value").agg(F.sum("n").alias("n"))


def _carried(sent: pa.Table, edges: pa.Table) -> pa.Table:
    """(node, tag, score, lo, hi) of a block: the tags of its sources at their targets, with two of their starts."""
    made, names = [sent.select(["node", "tag", "score", "lo", "hi"]).slice(0, 0)], ["node", "tag", "score", "lo", "hi"]
    if sent.num_rows and edges.num_rows:
        srcs, degrees, dsts, ends = (_one(edges[c]).flatten() for c in ("srcs", "degrees", "dsts", "ends"))
        sent, ends = sent.combine_chunks(), ends.to_numpy()
        tag, score = (_one(sent[c]).dictionary_encode() for c in ("tag", "score"))
        kind = tag.indices.to_numpy().astype(np.int64) * len(score.dictionary) + score.indices.to_numpy()
        kinds = len(tag.dictionary) * len(score.dictionary)
        starts = pa.concat_arrays([_one(sent["lo"]), _one(sent["hi"])]).dictionary_encode()
        lo, hi = np.split(starts.indices.to_numpy(), 2)
        code = pc.index_in(_one(sent["node"]), srcs).to_numpy(zero_copy_only=False).astype(np.int64)
        at, first, size = _lines(code, np.arange(len(code)), np.ones(len(code), np.int64), len(srcs))
        src = np.repeat(np.arange(len(srcs)), degrees.to_numpy())
        keep = size[src] > 0
        src, ends = src[keep], ends[keep]
        upto, i = np.cumsum(size[src]), 0
        while i < len(src):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PATHS, "right")))
            row = at[_ranges(first[src[i:j]], size[src[i:j]])]
            key = np.repeat(ends[i:j].astype(np.int64), size[src[i:j]]) * kinds + kind[row]
            order = np.argsort(key)
            key, row = key[order], row[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, least, most = key[new], np.minimum.reduceat(lo[row], new), np.maximum.reduceat(hi[row], new)
            of = key % kinds
            columns = [(dsts, key // kinds), (tag.dictionary, of // len(score.dictionary)), (score.dictionary, of % len(score.dictionary)), (starts.dictionary, least), (starts.dictionary, most)]
            made.append(pa.table([x.take(pa.array(y)) for x, y in columns], names))
            i = j
    return pa.concat_tables(made)


def carried(blocks: DataFrame, tags: DataFrame, hops: int) -> DataFrame:
    """(node, tag, score): tags(node, tag, score) at all nodes that their nodes lead to along the edges of packed(), by at most so many hops;
    a node's own tags count by others only.

    A row has a node's tag with one score and two of the nodes that it comes from, or one: two tell for any node whether another has it.
    In a round blocks get what is new at their sources, and no edge leaves them.
    """
    homes = blocks.select("block", F.explode("srcs").alias("node"))
    kind = lambda c: tags.schema[c].dataType.simpleString()
    schema = f"node {kind('node')}, tag {kind('tag')}, score {kind('score')}, lo {kind('node')}, hi {kind('node')}"
    key = ["node", "tag", "score"]
    level = cut(tags.select(*key).filter("node IS NOT NULL AND tag IS NOT NULL AND score IS NOT NULL").distinct().select(*key, F.col("node").alias("lo"), F.col("node").alias("hi")))
    every = level
    for _ in range(hops):
        sent = homes.join(level, "node").select("block", *level.columns)
        edges = blocks.withColumnRenamed("block", "_block")
        moved = sent.groupBy("block").cogroup(edges.groupBy("_block")).applyInArrow(_carried, schema).groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        had = every.groupBy(*key).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        level = cut(moved.join(had, key, "left").filter("_lo IS NULL OR _lo = _hi AND (lo <> _lo OR hi <> _hi)").select(*key, F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi")), measured=True)
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.filter("lo <> hi OR lo <> node").select(*key).distinct()
