"""Quality classifier: a generalised additive model with pairwise interactions over features of the whole text.

Shallow trees are boosted on one feature at a time, in turn; what they add up to is one lookup table a feature. Then
trees over the pairs that still explain most are boosted in turn, into one table a pair. A score is a sum of table
entries: the text's features are cut into bins once and the entries of all rows are added as vectors.

Cases: null and empty texts have features of their own (all zero) and get a score; without labels of both kinds the
score is the share of label 1, or 0.5; rows that repeat an id are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import map_text, pick
from changeloom.llm.labelled import held_out, sample

#: At most so many labelled rows of each label are learned from.
MOST_LABELLED = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST_ROWS = 64, 12, 150, 60, 6, 0.1, 20

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "pipe": b"|", "sign": b"#$%&*@^~+=", "bracket": b"<>{}[]()/\\_", "quote": b"\"'`-", "space": b" \t\r\x0b\x0c", "line": b"\n", "high": bytes(range(128, 256))}
_KINDS = np.array([[c in own for c in range(256)] for own in _CLASSES.values()], np.float64)
FEATURES = [*_CLASSES, "length", "words", "word_length", "distinct_words", "top_word", "long_words", "lines", "distinct_lines", "line_length", "upper_share", "end_sign", "repeats", "links"]


def features(text: bytes | None) -> list[float]:
    t = text or b""
    if not t:
        return [0.0] * len(FEATURES)
    n = len(t)
    kinds = _KINDS @ np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    words = t.split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    letters = kinds[0] + kinds[1]
    return [
        *(kinds / n).tolist(),
        np.log(n),
        np.log(k),
        sum(map(len, words)) / k,
        len(counts) / k,
        max(counts.values(), default=0) / k,
        sum(len(w) > 14 for w in words) / k,
        np.log(m),
        len(set(lines)) / m,
        np.log(n / m),
        kinds[0] / max(1.0, letters),
        sum(w[-1] in b"#$%&*!|" for w in words) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        (t.count(b"http") + t.count(b"www.")) / k,
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The best place to part bins in two, and what it gains; 0 where there is none."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(cg):
        return 0, 0.0
    gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    gains[(cn < LEAST_ROWS) | (n.sum() - cn < LEAST_ROWS)] = 0
    at = int(np.argmax(gains))
    return (at + 1, float(gains[at])) if gains[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bins in at most three runs, each with its step: two splits, the second where it gains most."""
    runs = [(0, len(g))]
    for _ in range(2):
        best = max(((_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in runs), key=lambda x: x[0][1])
        (at, gain), a, b = best
        if gain <= 0:
            break
        runs = [r for r in runs if r != (a, b)] + [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in runs:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid: rows are parted once, the columns of each side once; the better way round."""
    best, most = np.zeros(g.shape), -1.0
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for at in range(1, a.shape[0]):
            step, gain = np.zeros(a.shape), 0.0
            for rows in (slice(0, at), slice(at, None)):
                own = [x[rows].sum(axis=0) for x in (a, b, c)]
                cut, more = _split(*own)
                gain += more + float(_gain(own[0].sum(), own[1].sum()))
                for cols in (slice(0, cut), slice(cut, None)):
                    step[rows, cols] = own[0][cols].sum() / (own[1][cols].sum() + 1.0)
            if gain > most:
                best, most = (step.T if turned else step), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """x: rows of features; y: 0 or 1; weight: what a row counts for."""
    w = np.ones(len(y)) if weight is None else weight
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(float(np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))))
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)
    slope = lambda: (p := 1 / (1 + np.exp(-total)), w * (y - p), w * p * (1 - p))[1:]
    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables, strict=True):
            if len(table) < 2:
                continue
            g, h = slope()
            step = RATE * _tree(*(np.bincount(b, v, len(table)) for v in (g, h, np.ones(len(y)))))
            table += step
            total += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    size = [len(e) + 1 for e in model.pair_edges]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    grid = lambda i, j, v: np.bincount(coarse[i] * size[j] + coarse[j], v, size[i] * size[j]).reshape(size[i], size[j])
    g, h = slope()
    ones = np.ones(len(y))
    rank = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, ones))[1], i, j) for i in range(x.shape[1]) for j in range(i) if size[i] > 1 and size[j] > 1), reverse=True)
    model.pairs = [(i, j) for _, i, j in rank[:PAIRS]]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, ones))[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Only the features of the sampled rows come to the driver: ``most`` rows a label, a few dozen numbers each."""
    rows, all_rows = sample(docs, labels, label, most, doc_id, text)

    def make():
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    got = map_text(rows, text, make, [T.StructField("x", T.ArrayType(T.DoubleType()))], drop=True).select(doc_id, "y", "x").toPandas()
    got = got.sort_values(doc_id, kind="stable")
    y = got["y"].to_numpy(float)
    x = np.array(got["x"].tolist()).reshape(len(y), len(FEATURES))
    taken = [max(1.0, float((y == v).sum())) for v in (0, 1)]
    return fit(x, y, np.where(y == 1, all_rows[1] / taken[1], all_rows[0] / taken[0]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(shared.value.score(np.array([features(t) for t in texts])) if texts else [], pa.float64())]

    return map_text(docs, text, make, [T.StructField(out, T.DoubleType())])


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: whether it is held out, its score, and 1 where that reaches the cut."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    return score(pick(docs, doc_id, text), model, text).select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
