"""MinHash near-duplicates against all pairs, and their parts against what they promise."""

import random

import numpy as np

from changeloom.llm import minhash
from tests.llm.test_operators import by_sql, frame, texts


def brute(rows):
    """Row by row: (doc_id, set size, component)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    root = [*range(len(rows))]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                root[top(i)] = top(j)
    named = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            named[top(i)] = min(d, named.get(top(i), d))
    return sorted(((d, len(sets[i]), named.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, **options):
    got = minhash.near_duplicates(frame(spark, rows), **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def families(seed=5, many=40):
    r = random.Random(seed)
    out = []
    for _ in range(many):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 400))]
        out.append(words)
        for _ in range(4):
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, len(copy) // r.choice([20, 30, 45, 60, 200]))):
                copy[at] = f"x{r.randrange(4000)}"
            out.append(copy)
    return [*enumerate(" ".join(w) for w in out)]


def test_as_sql(spark):
    rows = [*texts(50), *((i + 1000, t) for i, t in families(many=8))]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == by_sql(spark, frame(spark, rows), "op11_minhash")


def test_as_all_pairs_with_odd_rows(spark):
    rows = [*families(), (None, "a b c d e"), (None, None), (9000, "A b  c d e"), (9001, "a b"), (9002, "A B"), (9003, ""), (9004, " \n"), (9005, None), (None, "zz"), (9001, "other words " * 9)]
    want = brute(rows)
    assert result(spark, rows) == want
    assert result(spark, rows, block=500) == want


def test_long_text_and_no_rows(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    assert result(spark, [(1, long), (2, long + " end"), (3, "short")]) == [(1, 59997, 1), (2, 59998, 1), (3, 1, 3)]
    assert result(spark, []) == []


def test_no_first_text_decides(spark):
    """A large group in which most pairs are just too different: links between others than the centres are found."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in r.sample(range(300), 9):
            copy[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        copy[r.randrange(300)] = "y"
        rows.append((i + 1000, " ".join(copy)))
    assert result(spark, rows, block=9000) == brute(rows)


def test_blocks_give_a_forest(spark):
    """Sets that are all alike, each of a label of its own, in three buckets: no bucket gives all its pairs, and all are joined."""
    r = np.random.default_rng(4)
    base = np.sort(r.integers(-(1 << 62), 1 << 62, 200))
    sets = {i: np.sort(np.concatenate([np.delete(base, [i, i + 70]), r.integers(-(1 << 62), 1 << 62, 2)])).tolist() for i in range(60)}
    rows = [(key, 0, home, True, i, i, own) for key in range(3) for home in (True, False) for i, own in sets.items()]
    rows += [(3, 0, home, True, i, 7, sets[i]) for home in (True, False) for i in (1, 2)]
    got = minhash.linked_in_blocks(spark.createDataFrame(rows, "key bigint, block bigint, home boolean, minor boolean, node bigint, label bigint, own array<bigint>"))
    links = got.collect()
    assert len(links) <= 3 * 59 and all(a > b for a, b in links)
    root = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(links, got.schema)).collect()}
    assert root == dict.fromkeys(range(60), 0)


def test_sketches():
    order = minhash.orders()
    assert all(sorted(row) == [*range(minhash.BINS)] for row in order[::50].tolist())
    r = np.random.default_rng(1)
    off = []
    for size in (1, 5, 40, 400, 5000):
        for share in (0.5, 0.8, 0.95):
            both = r.integers(0, 1 << 64, size, np.uint64)
            own = max(1, round(size * (1 - share) / (2 * share))) if size > 1 else 0
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 64, own, np.uint64)])) for _ in "ab")
            x, y = (np.frombuffer(minhash.sketch(s, order), np.uint8) for s in (a, b))
            union = len(np.union1d(a, b))
            off.append((x == y).mean() - len(np.intersect1d(a, b)) / union)
    assert np.abs(off).max() < 0.12 and abs(np.mean(off)) < 0.03
