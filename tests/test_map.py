"""The whole map of a small code base: contracts, consumers, sinks, served tags, emission, generated code, inherited ranks."""

import datetime as dt

from pyspark.sql import functions as F

from changeloom.operators import history
from changeloom.plans.codemap import build_map, callers, top_callers

NODES = "key string, repo string, file string, sym string, start int, end int, cyclo int, nest int, kind string, exported boolean, internal boolean, tags array<string>, category string"
EDGES = "src string, dst string, n int, kind string"


def node(key, repo, file, sym, kind="func", exported=False, internal=False, tags=(), category="core"):
    return (key, repo, file, sym, 1, 9, 6, 2, kind, exported, internal, list(tags), category)


WORLD = [
    node("op", "svc", "api/api.yaml", "Create", kind="api-op"),
    node("serve", "svc", "svc/serve.go", "Serve"),
    node("save", "svc", "dao/save.go", "Save"),
    node("mid", "svc", "dao/save.go", "mid", internal=True),
    node("gen", "svc", "dao/gen.go", "Gen", tags=["generated"]),
    node("lone", "svc", "svc/lone.go", "lone"),
    node("load", "web", "src/load.ts", "load", category="front"),
    node("tested", "svc", "svc/serve_test.go", "TestServe"),
]
CALLS = [("serve", "save", 2, "call"), ("save", "mid", 1, "call"), ("mid", "db.Exec", 1, "call"), ("save", "db.Exec", 1, "call"), ("serve", "gen", 1, "call"), ("mid", "gen", 1, "call"), ("tested", "serve", 1, "call")]
RULES = [
    {"id": "api", "score": 50, "kind": ["api-op"]},
    {"id": "dao", "score": 55, "floor": 52, "path": ["dao/**"]},
    {"id": "sql", "score": 70, "path": ["**/*.sql"]},
    {"id": "test", "score": 0, "cap": 10, "path": ["**/*_test.go"]},
]


def test_the_whole_map(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    ref = dt.datetime(2026, 9, 1)
    log = table([("svc", f"h{i}", ref - dt.timedelta(days=i + 1), "a@x", "fix it", i, [("M", "dao/gen.go"), ("M", "dao/save.go")]) for i in range(4)], "repo string, hash string, ts timestamp_ntz, email string, subject string, seq bigint, files array<struct<status: string, path: string>>")
    files = table([("svc", f, f == "dao/made.go") for f in ("api/api.yaml", "svc/serve.go", "dao/save.go", "dao/gen.go", "svc/lone.go", "svc/serve_test.go", "dao/deep/q.sql", "README.md", "dao/made.go")] + [("web", "src/load.ts", False)], "repo string, path string, generated boolean")
    options = {
        "files": files, "joined": table([("load", "op"), ("op", "serve")], "src string, dst string"), "sinks": [{"id": "db-write", "score": 65, "callee": [r"^db\.Exec$"]}],
        "consumers": [{"name": "sdk", "weight": 0.1, "specs": ["svc/api/**"]}], "emission": {"least_callers": 1}, "fixed": 6,
    }
    made = build_map(table(WORLD, NODES), table(CALLS, EDGES), log, RULES, F.lit(ref).cast("timestamp_ntz"), **options)
    rows = made.collect()
    by = {r["id"]: r for r in rows}
    assert len(by) == len(rows)
    # of symbols those with a caller elsewhere, an operation, or a high tag; internal ones and consumers have none
    assert {k for k, r in by.items() if r["level"] == "symbol"} == {"svc/api/api.yaml:Create", "svc/svc/serve.go:Serve", "svc/dao/save.go:Save", "svc/dao/gen.go:Gen"}
    tags = lambda k: {t["tag"]: t["score"] for t in by[k]["rollback_tags"] or []}
    # sinks: direct, then one and two hops away; the operation's own tag is served by what implements it
    assert tags("svc/dao/save.go:Save") == {"db-write": 65, "dao": 55}
    # the operation has the sink's tag from two hops away, which is served on
    assert tags("svc/svc/serve.go:Serve") == {"db-write": 59, "serves:api": 45, "serves:db-write": 47}
    assert tags("svc/api/api.yaml:Create") == {"db-write": 52, "api": 50} and tags("web/src/load.ts") == {"db-write": 46}
    assert by["svc/svc/serve.go:Serve"]["rollback"] == 65 and by["svc/dao/save.go:Save"]["impact"] >= 52
    # a file has its symbols' tags; a test's cap is its file's alone
    assert tags("svc/dao/save.go") == {"db-write": 65, "dao": 55} and by["svc/svc/serve_test.go"]["impact"] <= 10 and by["svc/svc/serve_test.go"]["impact_cap"] == 10
    # generated: a symbol's tag marks its file, a listed file is marked too; neither is likely to fail
    assert all(by[k]["likelihood"] == 0 for k in ("svc/dao/gen.go:Gen", "svc/dao/gen.go", "svc/dao/made.go")) and by["svc/dao/save.go"]["likelihood"] > 0
    # without nodes: the rank of the nearest ranked directory, or the root's, or 0
    assert by["svc/dao/deep/q.sql"]["rank_source"] == "inherited:svc/dao/" and by["svc/dao/deep/q.sql"]["rank"] == by["svc/dao/"]["rank"]
    assert by["svc/README.md"]["rank"] == 0 and by["svc/README.md"]["rank_source"] is None
    # callers by rank, seen through internal code; partners but for generated files
    assert set(by["svc/dao/gen.go:Gen"]["top_callers"]) == {"svc/svc/serve.go:Serve", "svc/dao/save.go:Save"} and by["svc/dao/gen.go:Gen"]["caller_files"] == 2
    assert by["svc/dao/save.go"]["cochange"] is None and [(p["path"], p["n"]) for p in by["svc/dao/gen.go"]["cochange"]] == [("dao/save.go", 4)]
    # a directory: its own rules (55), or the 75th percentile of its files (55, 55, 68, 73) if that is higher
    assert by["svc/dao/deep/"]["rollback"] == 73 and by["svc/dao/"]["rollback"] == 68 and by["svc/dao/"]["impact"] >= 52
    assert by["svc"]["level"] == "repo" and by["svc"]["symbols"] == 6 and set(tags("svc/dao/")) == {"dao"}


def test_callers_seen_through_internal_code(spark):
    nodes = spark.createDataFrame(WORLD, NODES)
    edges = spark.createDataFrame(CALLS, EDGES).select("src", "dst").unionByName(spark.createDataFrame([("virtual:sdk", "op")], "src string, dst string"))
    got = {r["node"]: r for r in callers(nodes, edges).collect()}
    assert (got["gen"]["callers"], got["gen"]["caller_files"]) == (2, 2)  # serve, and save through mid
    assert got["op"]["callers"] == 0 and got["op"]["virtual_caller"] and not got["gen"]["virtual_caller"]


def test_partners_without_what_follows_its_source(spark):
    files = [("M", p) for p in ("a.go", "b.go", "mocks/a.go", "made.go", "c_gen.go")]
    rows = history.changes(spark.createDataFrame([("r", f"h{i}", files) for i in range(3)], "repo string, hash string, files array<struct<status: string, path: string>>"))
    found = history.file_partners(rows, spark.createDataFrame([("r", "made.go")], "repo string, path string")).filter("item = 'a.go'")
    assert [r["partner"] for r in found.collect()] == ["b.go"]


def test_partners_of_one_path_in_two_repositories(spark):
    """What is generated in one, or never changes along in one, is a partner in the other; shares are of a repository's own changes."""
    log = [(r, f"h{i}", [("M", "a.go"), ("M", f"{r}.go"), ("M", "both.go")][: 2 if r == "s" and i > 2 else 3]) for r in ("r", "s") for i in range(6)]
    rows = history.changes(spark.createDataFrame(log, "repo string, hash string, files array<struct<status: string, path: string>>"))
    found = history.file_partners(rows, spark.createDataFrame([("r", "both.go")], "repo string, path string")).filter("item = 'a.go'").orderBy("repo", "rk")
    assert [(p["repo"], p["partner"], p["n"], p["conf"]) for p in found.collect()] == [("r", "r.go", 6, 1.0), ("s", "s.go", 6, 1.0), ("s", "both.go", 3, 0.5)]


def test_top_callers_by_rank(spark):
    nodes = spark.createDataFrame([*WORLD, *[node(f"c{i}", "web", "src/c.ts", f"c{i}") for i in range(7)]], NODES)
    edges = spark.createDataFrame([(f"c{i}", "mid") for i in range(7)] + [("mid", "gen"), ("virtual:sdk", "gen"), ("serve", "gen")], "src string, dst string")
    pr = spark.createDataFrame([(f"c{i}", float(i % 3)) for i in range(7)] + [("serve", 9.0)], "key string, pr double")
    got = {r["node"]: r["top_callers"] for r in top_callers(nodes, edges, pr).collect()}
    assert got["gen"] == ["svc/svc/serve.go:Serve", "web/src/c.ts:c2", "web/src/c.ts:c5", "web/src/c.ts:c1", "web/src/c.ts:c4"]
