import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.operators import graph, labels
from changeloom.session import cut


def closure(edges, hops=None):
    """(start, node) of all walks of at most so many edges, by brute force."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    found = set()
    for s in back:
        seen, edge, n = {s}, {s}, 0
        while edge and (hops is None or n < hops):
            edge = {a for x in edge for a in back.get(x, ())} - seen
            seen |= edge
            n += 1
        found |= {(s, x) for x in seen - {s}}
    return found


@pytest.mark.parametrize("hops", [2, None])
def test_tallies_are_those_of_pairs_in_any_blocks(spark, hops):
    """Blocks of a few edges change no count; copies, loops and nulls are no edges."""
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)] + [("n1", "n1"), ("n2", "n1"), ("n2", "n1"), (None, "n1"), ("n1", None)]
    of = {f"n{i}": (f"f{i % 7}" if i % 5 else None, f"r{i % 3}") for i in range(55)}  # five nodes aren't known
    nodes = spark.createDataFrame([(k, *v) for k, v in of.items()], "node string, file string, repo string")
    marks = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(0, 60, 2)], "sid string, node string")
    blocks = labels.packed(spark.createDataFrame(edges, "src string, dst string"), most=7)
    assert blocks.count() > 6
    want = {}
    for s, x in closure([e for e in edges if None not in e], hops):
        if x in of and int(s[1:]) % 2 == 0:
            for key in [("", None), *([("file", of[x][0])] if of[x][0] else []), ("repo", of[x][1])]:
                want[s, *key] = want.get((s, *key), 0) + 1
    assert {(r["sid"], r["of"], r["value"]): r["n"] for r in labels.reached_by(blocks, marks, nodes, hops).collect()} == want


def test_pieces_of_a_block(monkeypatch):
    """Pieces of a few paths, within a source too, change no tally."""
    rng = random.Random(5)
    targets = [[f"t{j}" for j in range(9) if rng.random() < 0.6 or j == i] for i in range(5)]
    has = [[f"l{j}" for j in range(30) if rng.random() < 0.4] for _ in range(9)]
    dsts = [f"t{j}" for j in range(9)]
    edges = pa.table({"srcs": [[f"s{i}" for i in range(5)]], "degrees": pa.array([[len(x) for x in targets]], pa.list_(pa.int32())), "dsts": [dsts], "ends": pa.array([[dsts.index(t) for x in targets for t in x]], pa.list_(pa.int32()))})
    sent = pa.table({"kind": pa.array([0] * 9 + [1], pa.int32()), "node": [*dsts, "s2"], "ids": [*has, ["l0", "l1"]]})
    want = {}
    for i, x in enumerate(targets):
        for label in {y for t in x for y in has[dsts.index(t)]} - ({"l0", "l1"} if i == 2 else set()):
            want[label] = want.get(label, 0) + 1
    for paths in (1 << 20, 5, 1):
        monkeypatch.setattr(labels, "PATHS", paths)
        got = labels._tallies(sent, edges, []).to_pylist()
        assert {r["sid"]: r["n"] for r in got} == want


def test_a_long_line_and_several_nodes_of_a_label(spark):
    """Twenty rounds end in time (estimates of sizes once doubled their digits in each)."""
    line = spark.createDataFrame([(i, i + 1) for i in range(20)], "src int, dst int")
    got = {r["sid"]: r["n"] for r in labels.reached_by(labels.packed(line), spark.createDataFrame([("x", 20), ("x", 10), ("y", 3)], "sid string, node int"), words=1).collect()}
    assert got == {"x": 19, "y": 3}  # 10 and 20 count by others only


@pytest.mark.parametrize("fixed", [1, 2, 6, None])
def test_ranks_are_those_of_all_nodes_moved(spark, fixed):
    """Nodes that nothing leads to aren't moved one by one, nor is an edge between them and others joined again; the ranks are the same."""
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(40), rng.randrange(25, 60)) for _ in range(90)})
    edges = [(a, b, 1.0 + (a * b) % 5) for a, b in pairs if a != b] + [(99, 30, 2.0), (3, 98, 1.0)]  # 98 and 99 aren't nodes
    share = {7: 0.2, 50: 0.1}
    out = {a: sum(w for x, _, w in edges if x == a) for a, _, _ in edges}
    tele = {i: share.get(i, (1 - 0.3) / 58) for i in range(60)}
    pr = dict(tele)
    for n in range(fixed or 200):
        lost = sum(pr[i] for i in pr if i not in out)
        next_ = {i: 0.15 * tele[i] + 0.85 * lost * tele[i] + 0.85 * sum(pr[a] * w / out[a] for a, b, w in edges if b == i and a in pr) for i in pr}
        far, pr = sum(abs(next_[i] - pr[i]) for i in pr), next_
        if fixed is None and far < 1e-10:
            break
    nodes = spark.createDataFrame([(i, share.get(i)) for i in range(60)], "id int, share double")
    got = {r["id"]: r["pr"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src int, dst int, w double"), fixed=fixed).collect()}
    assert got.keys() == pr.keys() and all(abs(got[i] - pr[i]) < 1e-12 for i in pr)


def test_two_hops_make_no_row_for_each_pair(spark, tmp_path):
    """Suppliers' counts come from tallies of blocks; edges are read with copies and as numbers."""
    from changeloom.queries import graphs

    lines = [(o, p, s) for o in range(6) for p, s in ((o % 3, 0), (o % 3, 1), (3, o % 2), (3, o % 2))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 10 + o // 2) for o in range(6)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,), (1,), (2,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = closure({(f"c{10 + o // 2}", f"p{p}") for o, p, _ in lines} | {(f"p{p}", f"s{s}") for _, p, s in lines}, 2)
    want = {s: (sum(x[0] == "p" for y, x in pairs if y == s), sum(x[0] == "c" for y, x in pairs if y == s)) for s, _ in pairs if s[0] == "s"}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "reach", None)  # no longer asked for pairs
        assert {r["sid"]: (r["parts"], r["customers"]) for r in graphs.reach_2hop_counts(spark, str(tmp_path)).collect()} == want


def test_dependents_and_callers_make_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    df, clear = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(f"n{i}",) for i in range(0, 30, 3)], "node string")
    want = {}
    for r in graph.direct_callers(df, clear).collect():
        want[r["node"]] = want.get(r["node"], 0) + 1
    monkeypatch.setattr(graph, "reach", None)
    monkeypatch.setattr(graph, "direct_callers", None)
    assert {r["node"]: r["callers"] for r in graph.caller_counts(df, clear).collect()} == want
    nodes = spark.createDataFrame([(f"n{i}", f"f{i % 4}", f"r{i % 2}", i % 5 == 0) for i in range(30)], "node string, file string, repo string, internal boolean")
    starts = clear.select("node", F.col("node").alias("sid"))
    found = {}
    for s, x in closure(edges, 2):
        if int(s[1:]) % 3 == 0 and int(x[1:]) % 5:
            found.setdefault(s, set()).add(int(x[1:]))
    got = {r["sid"]: (r["syms"], r["files"], r["repos"]) for r in graph.dependents(starts, df, nodes, 2).collect()}
    assert got == {s: (len(x), len({i % 4 for i in x}), sorted({f"r{i % 2}" for i in x})) for s, x in found.items()}


def test_tags_are_carried_without_their_starts(spark, monkeypatch):
    """A node's own tag counts by others only, also round a cycle; the highest score of the starts counts."""
    from changeloom.operators import contracts

    rng = random.Random(9)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(32)} | {("a", "b"), ("b", "a")}
    tags = [(f"n{i}", t, s) for i in range(25) for t, s in (("x", 40 + i % 3), ("y", 90), ("x", 10)) if (i + len(t + str(s))) % 2] + [("a", "z", 50)]
    want = {}
    for x, s in closure({(b, a) for a, b in edges}, 3):  # s leads from x
        for n, t, score in tags:
            if n == x and score >= 40:
                want[s, "serves:" + t] = max(want.get((s, "serves:" + t), 0), score - 5)
    df, ops = spark.createDataFrame(tags, "node string, tag string, score int"), spark.createDataFrame([(n,) for n, _, _ in tags], "node string")
    made = contracts.serve_tags(df, ops, spark.createDataFrame([(*e, "impl") for e in sorted(edges)] + [("a", "n1", "call")], "src string, dst string, kind string"))
    assert not hasattr(contracts, "reach")  # pairs of starts and nodes aren't asked for
    assert {(r["node"], r["tag"]): r["score"] for r in made.collect()} == want and ("a", "serves:z") not in want


def test_sizes_of_a_loop_that_joins_its_last_round(spark):
    """Each round's estimate was the square of the last one's: after 24 rounds, as in a history of 2^24 commits, millions of digits."""
    df = spark.range(3)
    for _ in range(24):
        df = cut(df.join(df.select((F.col("id") + 0).alias("id")), "id"), measured=True)
    assert df.count() == 3
