"""Toxicity classifier: words as bags of character n-grams, averaged into a linear softmax.

A word is itself and its n-grams of bytes (with marks at its ends), each hashed to a vector; a word's vector is their
mean, a text's the mean of its words'. Vectors and softmax are trained together in numpy. A misspelt word that no text
had still has most of its n-grams in common with the word. For a text everything is linear, so a scorer needs one
number for each hashed n-gram.

Every n-gram of the sampled rows has a vector that is trained. A text has thousands of n-grams and few of them matter, so
vectors are scaled by evidence: the more the shares of the two labels differ, in standard errors, the larger the
step of the vector and what it adds. Little evidence makes a vector small; none is left out. Steps get smaller in the
second half of the epochs, and the model is the mean over their ends, which the order of the rows hardly moves.

Cases: null and empty texts get the score of a text of no known n-gram; a very long text is read whole, in parts, and has
one number for each bucket at most; without labels of both kinds, and so from empty tables, the score is the share of
label 1, or 0.5; an empty table of documents gives no rows; rows that repeat an id are scored each and learned from as
one; labels that tie are told apart by the id; further columns are ignored, a column with the name of the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import cut, map_text, pick
from changeloom.llm.decontaminate import words_of
from changeloom.llm.labelled import held_out, sample

#: At most so many labelled rows of each label are learned from, and at most so many n-grams of them in all (48 MB): rows of
#: larger hashes of their ids are left out beyond that.
MOST_LABELLED, MOST_GRAMS = 3_000, 8_000_000
BUCKETS, WIDTH, GRAMS = 1 << 17, 4, (3, 4, 5)
EPOCHS, STEP_ROWS, RATE, DECAY, STEEPEST = 20, 128, 30.0, 1e-5, 0.05

#: The mean of many vectors is small; the softmax sees it this many times as large.
SCALE = 100.0

#: Standard errors at which a vector has its full scale, the power of the scale, and the largest one.
FULL_Z, POWER, LARGEST = 4.0, 3, 4.0

#: Weights go to the driver as half floats, this many times as large.
HALF = 1024.0

#: A worker keeps the numbers of so many words.
CACHE = 200_000
U = np.uint64


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the words, word by word, and where each word's begin."""
    marked = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(marked))  # bytes to the end of the word
    found, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, U)
        for k in range(n):
            h = (h ^ marked[at + k]) * U(0x100000001B3)
        found.append(h)
        owner.append(word[at])
    powers = np.cumprod(np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, U))
    whole = np.add.reduceat(marked * powers[np.repeat(sizes, sizes) - left], ends - sizes) if len(words) else np.empty(0, U)
    h, owner = np.concatenate([*found, whole]), np.concatenate([*owner, np.arange(len(words))])
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    order = np.argsort(owner, kind="stable")
    return (h[order] >> U(40)).astype(np.int64) & (BUCKETS - 1), np.searchsorted(owner[order], np.arange(len(words)))


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text and the weight of each in the mean; together at most BUCKETS numbers however long it is."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    total = np.zeros(BUCKETS)
    for i in range(0, len(words), 1 << 16):
        part = words[i : i + (1 << 16)]
        at, starts = grams(part)
        sizes = np.diff(np.append(starts, len(at)))
        total += np.bincount(at, np.repeat(1.0 / sizes, sizes), BUCKETS)
    there = np.flatnonzero(total)
    return there.astype(np.int32), (total[there] / len(words)).astype(np.float32)


@dataclass
class Model:
    base: float  # log odds of a text of no known n-gram
    value: np.ndarray  # what each bucket adds to the log odds

    def words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        at, starts = grams(words)
        return np.add.reduceat(self.value[at], starts) / np.diff(np.append(starts, len(at)))


def evidence(have: np.ndarray, n: tuple[float, float]) -> np.ndarray:
    """The scale of each bucket's vector. have: how many of the n texts of label 0 and of label 1 have the bucket."""
    share = (have.sum(axis=0) + 1) / (sum(n) + 2)
    spread = np.sqrt(share * (1 - share) * (1 / max(1, n[0]) + 1 / max(1, n[1])))
    z = np.abs(have[1] / max(1, n[1]) - have[0] / max(1, n[0])) / spread
    return np.minimum(LARGEST, (z / FULL_Z) ** POWER).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float) -> Model:
    """rows: buckets and weights, HALF times as large; prior: log odds of label 1 among all labelled rows."""
    if len(set(y.tolist())) < 2:
        return Model(prior, np.zeros(BUCKETS, np.float32))
    have = np.zeros((2, BUCKETS))
    for (at, _), v in zip(rows, y, strict=True):
        have[v, at] += 1
    scale = evidence(have, ((y == 0).sum(), (y == 1).sum()))
    rng = np.random.default_rng(7)
    vectors, soft, bias = np.zeros((BUCKETS, WIDTH), np.float32), rng.normal(0, 1, (WIDTH, 2)), np.zeros(2)
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    mean_value, mean_base, last = np.zeros(BUCKETS), 0.0, EPOCHS - EPOCHS // 2
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(y)), RATE * min(1.0, (EPOCHS - epoch) / last)
        for i in range(0, len(y), STEP_ROWS):
            part = order[i : i + STEP_ROWS]
            at, weight = (np.concatenate([rows[r][k] for r in part]) for k in (0, 1))
            weight = weight.astype(np.float32) / HALF * scale[at]
            own = np.repeat(np.arange(len(part)), [len(rows[r][0]) for r in part])
            mean = np.stack([np.bincount(own, weight * vectors[at, d], len(part)) for d in range(WIDTH)], axis=1)
            logits = SCALE * mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = (p - np.eye(2)[y[part]]) * balance[part, None] / len(part)
            back = (SCALE * err @ soft.T).astype(np.float32)
            of_vectors = np.stack([np.bincount(at, weight * back[own, d], BUCKETS) for d in range(WIDTH)], axis=1)
            slopes = (of_vectors, 0.01 * SCALE * mean.T @ err, 0.01 * err.sum(axis=0))
            step = rate * min(1.0, STEEPEST / max(1e-12, float(np.sqrt((of_vectors**2).sum()))))
            for x, g in zip((vectors, soft, bias), slopes, strict=True):
                x -= (step * (g + DECAY * x)).astype(x.dtype)
        if epoch >= last:
            mean_value += SCALE * scale * (vectors @ (soft[:, 1] - soft[:, 0])) / (EPOCHS - last)
            mean_base += float(bias[1] - bias[0]) / (EPOCHS - last)
    return Model(mean_base + prior, mean_value.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text", most_grams: int = MOST_GRAMS) -> Model:
    """The driver gets the bags of the sampled rows: at most ``most`` rows a label and ``most_grams`` n-grams."""
    rows, (none, some) = sample(docs, labels, label, most, doc_id, text)

    def make():
        def bags(texts: list[bytes | None]) -> list[pa.Array]:
            made = [bag(t) for t in texts]
            return [pa.array([len(a) for a, _ in made], pa.int64()), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([(w * HALF).astype(np.float16).tobytes() for _, w in made], pa.binary())]

        return bags

    fields = [T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("weight", T.BinaryType())]
    bags_of = cut(map_text(rows, text, make, fields, drop=True).select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("place"), "y", "n", "at", "weight"))
    sizes = bags_of.select("place", "n").toPandas().sort_values("place")
    last = sizes["place"][sizes["n"].cumsum() <= most_grams].max()
    got = bags_of.filter(F.col("place") <= (int(last) if len(sizes) and last == last else 0)).select("place", "y", "at", "weight").toArrow().combine_chunks()
    order = np.argsort(got["place"].to_numpy(), kind="stable")
    both = [_parts(got[c].combine_chunks(), kind) for c, kind in (("at", np.int32), ("weight", np.float16))]
    bags, y = [(both[0][i], both[1][i]) for i in order], got["y"].to_numpy()[order].astype(np.int64)
    share = np.clip(some / (none + some), 0.01, 0.99) if none + some else 0.5
    model = fit(bags, y, float(np.log(share / (1 - share))))
    del got, both, bags
    pa.default_memory_pool().release_unused()
    return model


def _parts(packed: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers in each row of a binary column, without a copy."""
    arrays = packed.chunks if isinstance(packed, pa.ChunkedArray) else [packed]
    out: list[np.ndarray] = []
    for a in arrays:
        ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] // np.dtype(kind).itemsize
        data = np.frombuffer(a.buffers()[2] or b"", kind)
        out += [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1, from all words of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, known = shared.value, {}

        def scores(texts: list[bytes | None]) -> list[pa.Array]:
            if len(known) > CACHE:
                known.clear()
            words = [words_of(t) for t in texts]
            new = list({w for own_words in words for w in own_words}.difference(known))
            known.update(zip(new, own.words(new).tolist(), strict=True))
            odds = np.array([own.base + (sum(map(known.__getitem__, w)) / len(w) if w else 0.0) for w in words])
            return [pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())]

        return scores

    return map_text(docs, text, make, [T.StructField(out, T.DoubleType())])


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: whether it is held out, its score, and 1 where that reaches the cut."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    return score(pick(docs, doc_id, text), model, text).select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
