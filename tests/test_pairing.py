"""Pairs by postings against all pairs."""

import random

from pyspark.sql import functions as F

from changeloom.operators import context, pairing


def test_shared_pairs_as_all_pairs(spark):
    r = random.Random(2)
    sets = {i: frozenset(f"t{min(int(r.expovariate(0.15)), 40)}" for _ in range(r.randrange(1, 14))) for i in range(90)}
    sets |= {100 + i: sets[i] for i in range(20)}
    often = {}
    for s in sets.values():
        for t in s:
            often[t] = often.get(t, 0) + 1
    classes = {}
    for i, s in sorted(sets.items()):
        if kept := frozenset(t for t in s if often[t] > 1):
            classes.setdefault(kept, []).append(i)
    reps = {ids[0]: (s, len(ids)) for s, ids in classes.items()}
    want = sorted((a, b, len(reps[a][0] & reps[b][0]), reps[a][1], reps[b][1]) for a in reps for b in reps if a < b and len(reps[a][0] & reps[b][0]) >= 3)
    rows = [(i, t, "x") for i, s in sets.items() for t in s] + [(0, next(iter(sets[0])), "y")]
    df = spark.createDataFrame(rows, "unit bigint, tok string, df string")
    got = sorted(tuple(x) for x in pairing.shared_pairs(df, "unit", "tok", 3).collect())
    assert got == want and len(want) > 100
    assert pairing.shared_pairs(df.limit(0), "unit", "tok", 3).isEmpty()


def test_scopes_stay_apart(spark):
    rows = [(s, u, t) for s in "pq" for u in (1, 2) for t in ("a", "b", "c") if (s, u, t) != ("q", 2, "c")]
    df = spark.createDataFrame(rows, "scope string, unit bigint, tok string")
    assert pairing.shared_pairs(df, "unit", "tok", 2, ["scope"]).isEmpty()  # both scopes have one class
    got = {tuple(r) for r in pairing.sharing(*[pairing.token_sets(df, "unit", "tok", ["scope"])] * 2, ["scope"], 3, ordered=True).collect()}
    assert got == {("p", 1, 2, 3)}


LINES = "array<struct<line_ord: int, op: string, text: string>>"


def brute(units, room):
    """The context of each unit by looking at all others."""
    out = {}
    for c, i, f, sym, lines, _, o in units:
        tell = lambda ls, op: {t.strip() for _, p, t in ls if p == op and len(t.strip().encode()) >= 12 and not t.strip().startswith("//")}
        diff = lambda ls: "\n".join(p + t for _, p, t in ls)
        words = lambda ls: set(__import__("re").findall("[A-Za-z0-9_]+", diff(ls)))
        items, hidden, moved = [], [], []
        for c2, i2, f2, sym2, lines2, skipped2, o2 in units:
            if c2 != c or i2 == i:
                continue
            if skipped2:
                hidden.append(i2)
                continue
            common = tell(lines, "+") & tell(lines2, "-")
            rank = 0 if len(common) >= 3 else 1 if (len(sym) > 2 and sym in words(lines2)) or (len(sym2) > 2 and sym2 in words(lines)) else 2 if f == f2 else 3
            items.append((rank, o2, i2, len(diff(lines2).encode()), len(common), min(common, key=lambda x: (-len(x.encode()), x), default=None)))
        shown, left = [], room
        for rank, _, i2, n, m, sample in sorted(items):
            if rank == 0:
                moved.append((i2, m, sample))
            if n <= left:
                shown.append(i2)
                left -= n
            else:
                hidden.append(i2)
        out[c, i] = (moved, shown, sorted(hidden))
    return out


def test_review_context_as_brute_force(spark):
    r = random.Random(6)
    names = ["Alpha", "beta_2", "Gamma", "fn", "Delta"]
    pool = [f"value{i} := compute(\t{i})" for i in range(12)] + ["short", "// a comment line here", "Alpha()", "call beta_2 now ok", "Gammas are not Gamma"]
    units = []
    for c in ("c1", "c2"):
        for k in range(14):
            lines = [(j, r.choice("+- "), r.choice(pool)) for j in range(r.randrange(0, 14))]
            units.append((c, f"u{k:02}", f"f{k % 4}.go", r.choice([*names, ""]), lines, k % 5 == 4, k))
    units.append(("c3", "alone", "x.go", "X", [(0, "+", "only line of it all")], False, 0))
    df = spark.createDataFrame(units, f"change_id string, id string, file string, symbol string, lines {LINES}, skipped boolean, ord int")
    for room in (32_000, 400):
        got = {(x["change_id"], x["id"]): ([tuple(m) for m in x["moved"]], x["shown"], x["hidden"]) for x in context.review_context(df, room).collect()}
        want = brute(units, room)
        assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
        assert got == want


def test_telling(spark):
    rows = spark.createDataFrame([("\t  long enough line ",), ("short",), ("  // a long comment",), (None,)], "x string")
    assert [r[0] for r in rows.select(context.telling(F.col("x"))).collect()] == ["long enough line", None, None, None]
