"""Codes of vectors against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np

from changeloom.llm import vector_codes
from tests.llm.test_operators import by_sql

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y") for i, v, k in rows], SCHEMA).repartition(3)


def plain(rows):
    kept = [(i, [math.floor(4096 * np.float64(x)) for x in np.array(v, np.float32)], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1])
    cuts = [(i * d // 8, (i + 1) * d // 8) for i in range(8)]
    books = [[v[a:b] for _, v, _ in kept[:16]] for a, b in cuts]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(6):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v[a:b], books[p])[1], []).append(v[a:b])
            for e, parts in groups.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for i, v, k in kept:
        found = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), k])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted([(i, c, e, total[k], sha) for i, c, e, k in out], key=str)


def vectors(n, d=16, seed=1):
    r = random.Random(seed)
    grid = [[r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(d)] for _ in range(6)]
    return [(i, [x + (r.gauss(0, 0.1) if i % 3 else 0) for x in grid[r.randrange(6)]], r.choice([None, 0, 1, 2])) for i in range(n)]


def result(spark, rows):
    got = vector_codes.compressed(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_as_plain_and_as_sql(spark):
    rows = vectors(300)
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [float("nan")], 1), (903, [float("inf")] * 16, 1), (904, [None] * 16, 1), (905, [1.0] * 24, 1), (3, rows[9][1], 2), (None, rows[5][1], None), (7, rows[7][1], 1)]
    assert result(spark, rows + odd) == plain(rows + odd)
    assert result(spark, rows) == by_sql(spark, frame(spark, rows).select("vec_id", "embedding", "label"), "op12_vector_codes", embeddings=frame(spark, rows).select("vec_id", "embedding", "label"))


def test_few_equal_and_no_vectors(spark):
    assert result(spark, vectors(5)) == plain(vectors(5))
    equal = [(i, [0.5] * 8, 1) for i in range(40)]
    assert result(spark, equal) == plain(equal)
    assert result(spark, []) == [] and result(spark, [(1, None, 1), (2, [], None)]) == []
    short = [(i, [float(i), -1.5, 2.25], None) for i in range(30)]
    assert result(spark, short) == plain(short)


def test_large_numbers(spark):
    rows = [(i, [float(x) * 2.0**20 for x in v], k) for i, v, k in vectors(40)] + [(999, [3e18] * 16, 1)]
    got = {r[0]: r[1:3] for r in result(spark, rows)}
    want = {r[0]: r[1:3] for r in plain(rows)}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == (w[1] if w[1] < 1 << 63 else None) for i, w in want.items())


def test_search_by_lists():
    r = np.random.default_rng(2)
    for k, d in ((1, 4), (2, 1), (16, 8), (64, 3)):
        book = r.integers(-30, 30, (k, d))
        book[-1] = book[0]
        q = np.concatenate([r.integers(-40, 40, (500, d)), book])
        far = ((q[:, None] - book[None]) ** 2).sum(axis=2)
        entry, best, looked = vector_codes.orchard(q, book)
        assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and looked <= len(q) * k
    clusters = r.integers(-1000, 1000, (64, 8))
    q = clusters[r.integers(0, 64, 2000)] + r.integers(-9, 9, (2000, 8))
    assert vector_codes.orchard(q, clusters)[2] < 0.7 * len(q) * 64
