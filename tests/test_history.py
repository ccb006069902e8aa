"""Ancestors by pointer doubling, advancing histories, the stream that keeps them, and logs read by day."""

import random
from datetime import datetime, timezone

from changeloom.operators import history
from changeloom.sources import commits
from changeloom.streaming import follow
from tests.test_streaming import run

SCHEMA = "repo string, seq bigint, hash string, parents array<string>"


def graph(r, n):
    """Commits 0..n-1 with parents among the earlier ones, mostly the one before."""
    out = {}
    for i in range(n):
        first = [i - 1] if i and r.random() < 0.9 else [r.randrange(i)] if i and r.random() < 0.8 else []
        out[i] = first + [r.randrange(i) for _ in range(r.choice([0, 0, 0, 1, 2])) if i]
    return out


def test_ancestors_of_any_graph(spark):
    r = random.Random(4)
    graphs = {f"r{k}": graph(r, 60) for k in range(4)}
    graphs["line"] = {i: [i - 1] if i else [] for i in range(70)}
    rows = [(k, -i, str(i), [str(p) for p in ps]) for k, g in graphs.items() for i, ps in g.items()] + [("cut", 0, "5", ["4"])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for k, g in graphs.items():
        todo, seen = [max(g)], set()
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += g[i]
        want |= {(k, str(i)) for i in seen}
    starts = spark.createDataFrame([(k, str(max(g))) for k, g in graphs.items()] + [("cut", "5"), ("none", "1")], "repo string, hash string")
    assert {tuple(x) for x in history.ancestors(df, starts).collect()} == want | {("cut", "5")}
    marks = spark.createDataFrame([("line", "3", "69"), ("r0", "59", "2"), ("cut", "4", "5"), ("none", "1", "1")], "repo string, old string, new string")
    assert {x["repo"]: x["ancestor"] for x in history.is_ancestor(df, marks).collect()} == {"line": True, "r0": False, "cut": False, "none": False}


def log(*rows):
    """Rows (repo, hash, parents) as a log lists them, the newest first."""
    return [(r, i, h, p) for i, (r, h, p) in enumerate(rows)]


def kept(spark, path):
    rows, heads = follow.stored(spark, path, spark.createDataFrame([], SCHEMA).schema)
    return {(x["repo"], x["hash"]) for x in rows.collect()}, {x["repo"]: x["old"] for x in heads.collect()}


def test_followed_history(spark, tmp_path):
    """Appended, rewritten and replayed logs."""
    feed = lambda *rows: spark.createDataFrame(log(*rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda: run(follow.follow_history(stream(), f"{tmp_path}/out", f"{tmp_path}/check"))
    feed(("a", "2", ["1"]), ("a", "1", []), ("b", "x", []))
    keep()
    assert kept(spark, f"{tmp_path}/out") == ({("a", "1"), ("a", "2"), ("b", "x")}, {"a": "2", "b": "x"})
    feed(("a", "4", ["3", "s"]), ("a", "3", ["2"]), ("a", "s", ["1"]), ("b", "z", ["y"]), ("b", "y", []))
    keep()
    want = ({("a", h) for h in "1234s"} | {("b", "y"), ("b", "z")}, {"a": "4", "b": "z"})
    assert kept(spark, f"{tmp_path}/out") == want
    # the same batch once more, as after a failure before it was recorded
    known, heads = follow.stored(spark, f"{tmp_path}/out", spark.createDataFrame([], SCHEMA).schema, 1)
    again = spark.createDataFrame(log(("a", "4", ["3", "s"]), ("a", "3", ["2"]), ("a", "s", ["1"]), ("b", "z", ["y"]), ("b", "y", [])), SCHEMA)
    history.advance(known, heads, again).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=1")
    assert kept(spark, f"{tmp_path}/out") == want
    feed(("a", "4", ["3", "s"]), ("a", "3", ["2"]))
    keep()
    assert kept(spark, f"{tmp_path}/out") == want


def test_log_by_day(spark, tmp_path):
    day = 86_400
    base = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp())
    text = lambda i: commits.FIELD.join([f"h{i}", str(base + i * day // 2), "A@x", f"subject {i}"]) + "\nM\ta.go\nR100\told.go\tnew.go"
    rows = [(r, text(i)) for r in ("p", "q") for i in range(20)] + [("p", "broken")]
    commits.write_log(spark.createDataFrame(rows, "repo string, text string"), f"{tmp_path}/log")
    whole = commits.scan_log(spark, f"{tmp_path}/log")
    assert whole.count() == 40 and [tuple(f) for f in whole.first()["files"]] == [("M", "a.go"), ("R", "new.go")]
    since = datetime(2026, 1, 8, 12)
    some = commits.scan_log(spark, f"{tmp_path}/log", since, ["p"])
    assert sorted(r["hash"] for r in some.collect()) == sorted(f"h{i}" for i in range(15, 20))
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # files of earlier days aren't opened: broken ones don't matter
    folder = f"{tmp_path}/log/repo=p/day=2026-01-02"
    for f in __import__("pathlib").Path(folder).glob("part-*"):
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        f.mkdir()
    assert some.count() == 5
    newest = commits.scan_log(spark, f"{tmp_path}/log", since, limit=2)
    assert sorted((r["repo"], r["hash"]) for r in newest.collect()) == [(r, h) for r in "pq" for h in ("h18", "h19")]
