"""Byte-level BPE: texts to ids and back, by a local rank file and the tiktoken library.

Long texts are cut where a match of the pattern always ends: before white space that follows a character of another
kind. A part that has no such place is split by the pattern itself, and its long matches are merged here with a heap,
in the order of the library, in n log n steps.

Cases: a null or empty text has no ids, and no ids decode to no bytes; ids are decoded to raw bytes, so any list of
ids can be decoded even where it isn't UTF-8; special tokens don't exist; further columns stay as they are, but for those
with the name of a result, which are replaced; rows that repeat stay rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeloom.llm.common import map_text, once, pick

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Characters that go to the library at once, about, and bytes of a match above which it is merged here.
PART, LONG = 50_000, 1_000
SAFE = regex.compile(r"(?<=\S)(?=\s)")


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.digits = [str(i) for i in range(max(self.ranks.values()) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= PART else (m.start() if (m := SAFE.search(text, at + PART)) else len(text))
            part = text[at:end]
            if len(part) <= 2 * PART:
                out += self.library.encode_ordinary(part)
            else:
                for m in self.pattern.finditer(part):
                    piece = m[0].encode()
                    out += self.merge(piece) if len(piece) > LONG else self.library.encode_ordinary(m[0])
            at = end
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match: the pair of neighbours with the lowest rank is merged, the leftmost of equals first."""
        n, rank = len(piece), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i] = 1, stop
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return once(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the ids of the text, an array of INT."""

    def make():
        own = codec(path, pattern)
        return lambda texts: [pa.array([np.array(own.encode((t or b"").decode()), np.int32) for t in texts], pa.list_(pa.int32()))]

    return map_text(docs, text, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the raw bytes of the ids, BINARY."""
    docs = docs.select(*[c for c in docs.columns if c != out])
    at, schema = docs.columns.index(ids), T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            flat, ends = batch.column(at).values.to_numpy(zero_copy_only=False), batch.column(at).offsets.to_numpy()
            made = pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """A row a document: tokens, the digest of its ids, and the digest of what they decode to."""

    def make():
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def both(texts: list[bytes | None]) -> list[pa.Array]:
            n, first, second = [], [], []
            for t in texts:
                ids = own.encode((t or b"").decode())
                n.append(len(ids))
                first.append(sha(" ".join([own.digits[i] for i in ids]).encode()))
                second.append(sha(own.decode(ids)))
            return [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

        return both

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_text(pick(docs, doc_id, text), text, make, fields, drop=True)
