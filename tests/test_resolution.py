"""Aliases, inherited members, all dependents at once, and percentiles at the tolerance, against plain loops."""

import random

from changeloom.operators import graph, members, windows


def test_aliases(spark):
    r = random.Random(3)
    rows = [("m", f"n{i}", f"n{r.randrange(40)}", 0) for i in range(30)] + [("m", f"n{i}", "later", 1) for i in range(30)]
    rows += [("line", f"k{i}", f"k{i + 1}", 0) for i in range(12)] + [("self", "a", "a", 0), ("two", "a", "b", 0), ("two", "b", "a", 0)]
    df = spark.createDataFrame(rows, "scope string, name string, target string, ord int")
    first = {}
    for scope, name, target, ord_ in sorted(rows, key=lambda x: x[3]):
        first.setdefault((scope, name), target)
    for depth in (1, 5, 8):
        want = {}
        for (scope, name), at in first.items():
            steps = 1
            while (scope, at) in first and steps < depth:
                at, steps = first[scope, at], steps + 1
            want[scope, name] = (None, None) if (scope, at) in first else (at, steps)
        got = {(x["scope"], x["name"]): (x["means"], x["steps"]) for x in members.resolved_aliases(df, ["scope"], depth).collect()}
        assert got == want
    assert want["line", "k0"] == (None, None) and want["line", "k4"] == ("k12", 8) and want["two", "a"] == (None, None)


def test_inherited_members(spark):
    supers = [("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "Y", 0), ("Y", "X", 0)] + [(f"t{i}", f"t{i + 1}", 0) for i in range(9)]
    own = [("A", "f", "A.f", 0), ("C", "f", "C.f", 0), ("C", "g", "C.g", 0), ("D", "h", "D.h", 1), ("D", "h", "D.h0", 0), ("Y", "m", "Y.m", 0), ("t9", "z", "t9.z", 0)]
    got = {(x["type"], x["name"]): (x["key"], x["via"], x["hops"]) for x in members.inherited_members(spark.createDataFrame(own, "type string, name string, key string, ord int"), spark.createDataFrame(supers, "type string, super string, ord int")).collect()}
    assert got["D", "f"] == ("A.f", "A", 2)  # B's own line is looked at before C
    assert got["D", "g"] == ("C.g", "C", 1) and got["D", "h"] == ("D.h0", "D", 0) and got["C", "f"] == ("C.f", "C", 0)
    assert got["X", "m"] == ("Y.m", "Y", 1) and got["Y", "m"] == ("Y.m", "Y", 0)
    assert ("t2", "z") not in got and got["t3", "z"] == ("t9.z", "t9", 6)


def test_all_dependents(spark):
    r = random.Random(7)
    pairs = {(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(130)} | {("a", "b"), ("b", "a"), ("c", "c")}
    nodes = sorted({x for p in pairs for x in p})
    up = {}
    for a, b in pairs:
        up.setdefault(b, set()).add(a)
    want = {}
    for n in nodes:
        todo, seen = [n], set()
        while todo:
            for x in up.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        seen.discard(n)
        if seen:
            want[n] = (len(seen), len({x[-1] for x in seen}), len({x[0] for x in seen}))
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    table = spark.createDataFrame([(n, n[-1], n[0]) for n in nodes], "node string, file string, repo string")
    got = {x["node"]: tuple(x)[1:] for x in graph.dependent_counts(edges, table, words=1).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want


def test_percentile_at_tolerance(spark):
    values = [1.0, 1.0 + 5e-10, 1.0 + 2e-9, 1.0 - 2e-9, 0.0, -1.0, -1.0 - 2e-9, -1.0 + 5e-10, 3e300, 5e-324, None]
    rows = [(i, v, i % 3 != 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v double, real boolean")
    for include in (None, df["real"]):
        some = [v for _, v, real in rows if v is not None and (include is None or real)]
        below = lambda v: sum(x < (v * (1 + 1e-9) if v < 0 else v * (1 - 1e-9)) for x in some)  # noqa: B023, E731
        want = {i: 100.0 * below(v) / len(some) if v is not None and (include is None or real) else None for i, v, real in rows}
        assert {x["id"]: x["percentile"] for x in windows.percentile_below(df, "v", include=include).collect()} == want
