"""Golden values of the operators, and their edges."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from changeloom.functions import patterns, scalars
from changeloom.operators import decisions, evaluation, graph, hierarchy, history, joins, windows
from changeloom.plans.lookup import fallback_lookup
from changeloom.plans.triage import triage
from changeloom.plans.codemap import build_map, top_records
from changeloom.sources.commits import parse_log, parse_target
from changeloom.sources.diffs import parse_diff, units
from changeloom.sources.maps import counts, read_map, write_map


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pagerank_and_percentile(spark):
    nodes = spark.range(4)
    edges = spark.createDataFrame([(0, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src bigint, dst bigint, w double")
    ranks = graph.pagerank(nodes, edges)
    pr = {r["id"]: r["pr"] for r in ranks.collect()}
    assert pr[3] > pr[2] > pr[0] and math.isclose(pr[0], pr[1]) and math.isclose(sum(pr.values()), 1)
    pct = {r["id"]: r["percentile"] for r in windows.percentile_below(ranks, "pr").collect()}
    assert pct == {0: 0, 1: 0, 2: 50, 3: 75}


def commits(spark):
    ref = dt.datetime(2026, 9, 1)
    many = [("M", "sync.go")] + [("M", f"f{i % 45}.go") for i in range(50)]
    rows = [
        (300, "ann@x", "add sync", [("A", "sync.go"), ("A", "sync_test.go")]),
        (200, "bob@x", "fix: retry on 503", [("M", "sync.go"), ("M", "sync_test.go")]),
        (10, "ann@x", "Fix panic in sync loop", [("M", "sync.go"), ("M", "go.sum")]),
        (5, "cy@x", "fix typo in comment", [("M", "sync.go")]),
        (3, "bob@x", 'Revert "speed up sync"', [("M", "sync.go"), ("M", "sync_test.go")]),
        (2, "ann@x", "gofmt everything", many),
        (400, "old@x", "fix ancient bug", [("M", "sync.go")]),
    ]
    data = [("r", f"h{i}", ref - dt.timedelta(days=a), e, s, i, f) for i, (a, e, s, f) in enumerate(rows)]
    return spark.createDataFrame(data, "repo string, hash string, ts timestamp_ntz, email string, subject string, seq bigint, files array<struct<status: string, path: string>>"), F.lit(ref).cast("timestamp_ntz")


def test_history(spark):
    log, ref = commits(spark)
    rows = history.changes(log)
    stats = {r["path"]: r for r in history.file_history(rows, ref).collect()}
    s = stats["sync.go"]
    assert (s["commits"], s["fixes"], s["reverts"], s["authors"], s["created"], s["age_days"]) == (5, 2, 1, 3, "ann@x", 2)
    assert 1.40 <= s["recent_fixes"] <= 1.45 and "go.sum" not in stats
    kept = rows.filter(history.in_window(F.col("ts"), ref))
    partners = history.file_partners(kept).filter("item = 'sync.go'").collect()
    assert [(p["partner"], p["n"], p["conf"]) for p in partners] == [("sync_test.go", 3, 0.6)]


def test_history_starts_over_after_a_deletion(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    data = [("r", f"h{n}", day(n), "a@x", "fix", n, status, "f") for n, status in ((1, "A"), (2, "M"), (3, "D"), (4, "A"), (5, "M"))]
    rows = spark.createDataFrame(data, "repo string, hash string, ts timestamp_ntz, email string, subject string, seq int, status string, path string")
    got = history.file_history(rows, F.lit(day(6)).cast("timestamp_ntz")).first()
    assert (got["commits"], got["fixes"]) == (2, 2)


def test_merge_history_equals_a_full_read(spark):
    log, _ = commits(spark)
    fresh, old = log.filter("seq IN (2, 3, 4, 5)"), log.filter("seq NOT IN (4, 5)")
    merged = history.merge_history(fresh, old, F.lit("2025-01-01").cast("timestamp_ntz"))
    assert sorted(r["hash"] for r in merged.collect()) == sorted(r["hash"] for r in log.collect())
    assert history.merge_history(fresh, old, F.lit("2025-01-01").cast("timestamp_ntz"), 2).count() == 2


RECORDS = [
    ("svc", "repo", "svc", "", None, None, 40, 50.0, 20, None),
    ("svc/dao/", "dir", "svc", "dao", None, None, 60, 80.0, 40, None),
    ("svc/dao/q.go", "file", "svc", "dao/q.go", None, None, 65, 85.0, 45, None),
    ("svc/dao/q.go:(*Queries).Insert", "symbol", "svc", "dao/q.go", "(*Queries).Insert", [10, 20], 80, None, 65, None),
    ("svc/dao/q.go:Helper", "symbol", "svc", "dao/q.go", "Helper", [22, 30], 30, None, None, None),
]
RULES = [{"id": "db-migration", "score": 95, "floor": 70, "path": ["**/migrations/**"]}, {"id": "test", "score": 0, "cap": 10, "path": ["**/*_test.go"]}]


def records(spark):
    return spark.createDataFrame(RECORDS, "id string, level string, repo string, path string, sym string, lines array<int>, impact int, rank double, rollback int, impact_cap int")


def test_fallback_lookup(spark):
    cases = {
        "svc/dao/q.go:Queries.Insert": ("symbol", "svc/dao/q.go:(*Queries).Insert", 80),
        "svc/dao/q.go:15-24": ("symbol", "svc/dao/q.go:(*Queries).Insert", 80),
        "svc/dao/q.go:25": ("symbol", "svc/dao/q.go:Helper", 30),
        "svc/dao/q.go:5": ("file", "svc/dao/q.go", 65),
        "svc/dao/q.go:Missing": ("file", "svc/dao/q.go", 65),
        "svc/dao/new.go": ("dir", "svc/dao/", 40),
        "svc/dao/migrations/002.sql": ("dir", "svc/dao/", 70),
        "svc/dao/q_test.go": ("dir", "svc/dao/", 10),
        "svc/other/x.go": ("repo", "svc", 23),
        "code/unknown/x.go": ("none", None, None),
    }
    q = spark.createDataFrame(list(enumerate(cases)), "qid bigint, text string").select("qid", parse_target(F.col("text")).alias("t")).select("qid", "t.*", F.lit(False).alias("new_file"))
    got = {r["qid"]: (r["matched"], r["basis"][0] if r["basis"] else None, r["impact"]) for r in fallback_lookup(q, records(spark), RULES).collect()}
    assert got == dict(enumerate(cases.values()))


def test_fallback_to_a_class(spark):
    rows = [("r", "repo", "r", "", None, None, 1, 1.0, 1, None), ("r/a.ts", "file", "r", "a.ts", None, None, 7, 1.0, 1, None), ("r/a.ts:Svc", "symbol", "r", "a.ts", "Svc", [1, 9], 50, None, 1, None), ("r/a.ts:Svc.hot", "symbol", "r", "a.ts", "Svc.hot", [2, 3], 60, None, 1, None)]
    q = spark.createDataFrame([(1, "r", "a.ts", s, None, None, False) for s in ("Svc.hot",)] + [(2, "r", "a.ts", "Svc.cold", None, None, False), (3, "r", "a.ts", "Other.x", None, None, False)], "qid bigint, repo string, path string, sym string, lo int, hi int, new_file boolean")
    got = {r["qid"]: r["impact"] for r in fallback_lookup(q, spark.createDataFrame(rows, records(spark).schema), []).collect()}
    assert got == {1: 60, 2: 50, 3: 7}


DIFF = """noise before
diff --git a/go.sum b/go.sum
index 1..2 100644
--- a/go.sum
+++ b/go.sum
@@ -1 +1 @@
-old
+new
diff --git a/a.go b/b.go
similarity index 100%
rename from a.go
rename to b.go
diff --git a/m/001.sql b/m/001.sql
new file mode 100644
--- /dev/null
+++ b/m/001.sql
@@ -0,0 +1,2 @@
+create table t
+-- comment
diff --git a/x.png b/x.png
Binary files a/x.png and b/x.png differ
diff --git a/sync.go b/sync.go
--- a/sync.go
+++ b/sync.go
@@ -10,5 +10,6 @@ func a
 ctx
--- a removed line that looks like a header
+added one
+added two
 ctx
 func b
+in b"""


def test_diffs(spark):
    files, lines = parse_diff(spark.createDataFrame([("c1", DIFF), ("c2", "")], "change_id string, text string"))
    got = [(r["path"], r["old_path"], r["status"], r["binary"], r["n_hunks"]) for r in files.orderBy("file_ord").collect()]
    assert got == [("go.sum", "go.sum", "modified", False, 1), ("b.go", "a.go", "renamed", False, 0), ("m/001.sql", "m/001.sql", "added", False, 1), ("x.png", "x.png", "modified", True, 0), ("sync.go", "sync.go", "modified", False, 1)]
    own = [(r["op"], r["old_no"], r["new_no"]) for r in lines.filter("file_ord = 5").orderBy("line_ord").collect()]
    assert own == [(" ", 10, 10), ("-", 11, 11), ("+", 12, 11), ("+", 12, 12), (" ", 12, 13), (" ", 13, 14), ("+", 14, 15)]
    assert lines.filter("file_ord = 3").agg(F.min("old_no"), F.min("new_no")).first()[0:2] == (1, 1)
    decls = spark.createDataFrame([("c1", "sync.go", "a", 5, 13, 0), ("c1", "sync.go", "b", 14, 30, 1)], "change_id string, path string, name string, start int, end int, ord int")
    made = {r["id"]: (r["added"], r["removed"]) for r in units(files, lines, decls).collect()}
    assert made == {"b.go": (0, 0), "x.png": (0, 0), "go.sum": (1, 1), "m/001.sql": (2, 0), "sync.go:a": (2, 1), "sync.go:b": (1, 0)}


def test_triage(spark):
    diffs = spark.createDataFrame([("c1", DIFF)], "change_id string, text string")
    decls = spark.createDataFrame([("c1", "sync.go", "a", 5, 13, 0), ("c1", "sync.go", "b", 14, 30, 1)], "change_id string, path string, name string, start int, end int, ord int")
    answers = spark.createDataFrame([("c1", "sync.go:a", "none", "format", 0.95), ("c1", "m/001.sql", "skim", "behavior", 0.9)], "change_id string, id string, bucket string, change_kind string, confidence double")
    issues = spark.createDataFrame([("c1", "m/001.sql", "high")], "change_id string, id string, severity string")
    got = {r["id"]: (r["bucket"], r["ord"]) for r in triage(diffs, decls, records(spark), RULES, "svc", answers, issues).collect()}
    assert got["go.sum"][0] == "none" and got["sync.go:b"][0] == "human" and got["m/001.sql"] == ("human", 1)


def test_budget_what_if(spark):
    pairs = [(63, 53), (79, 36), (78, 36), (70, 36), (59, 38), (54, 36), (54, 36), (43, 40), (39, 41)]
    rows = [(i, a, b, "behavior", "human", "model", 0.9, [], 10) for i, (a, b) in enumerate(pairs)]
    u = spark.createDataFrame(rows, "id int, impact int, likelihood int, change_kind string, bucket string, source string, confidence double, risk_signals array<string>, chars int")
    scored = decisions.score_units(u).withColumns({"attention": F.lit(0), "clean": F.lit(1.0)}).drop("bucket")
    placed = decisions.place(scored, decisions.budgets(spark)).withColumns({"label": F.lit("human"), "n_issues": F.lit(0)})
    got = {r["budget"]: (r["human"], r["skim"]) for r in evaluation.what_if(placed).collect()}
    assert (got["most"], got["balanced"], got["least"]) == ((9, 0), (1, 8), (0, 9))


def test_attention_and_escalation(spark):
    levels = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, decisions.attention(levels())) == 0 and one(spark, decisions.attention(levels("high", "low"))) == 80
    cases = [("none", 0.95, False, "none"), ("none", 0.8, False, "skim"), ("none", 0.95, True, "skim"), ("skim", 0.6, False, "human"), ("human", 0.1, False, "human"), ("skim", 0.9, True, "skim"), ("none", 0.5, True, "skim")]
    for bucket, confidence, cut, want in cases:
        assert one(spark, decisions.escalate(F.lit(bucket), F.lit(confidence), F.lit(cut))) == want


def test_decoding(spark):
    good = '{"bucket":"skim","change_kind":"test","confidence":0.7,"reason":"x"}'
    rows = spark.createDataFrame([(f"text {good} more",), ('{"bucket":"later"}',), ("",), (None,)], "a string")
    got = [r["d"] for r in rows.select(decisions.decode_decision(F.col("a")).alias("d")).collect()]
    assert got[0]["ok"] and got[0]["bucket"] == "skim" and not any(g["ok"] for g in got[1:]) and got[1]["bucket"] == "human"
    issue = "array(named_struct('severity', 'critical', 'title', 'a', 'unseen', false, 'preexisting', true, 'scenario', 's'), named_struct('severity', 'odd', 'title', 'b', 'unseen', false, 'preexisting', false, 'scenario', 's'), named_struct('severity', 'high', 'title', 'c', 'unseen', true, 'preexisting', false, 'scenario', 's'))"
    made = one(spark, decisions.decode_issues(F.expr(issue)))
    assert [(x["severity"], x["claimed"]) for x in made["issues"]] == [("low", "critical"), ("medium", None)] and made["checks"] == ["c"]


def test_evaluation(spark):
    rules = spark.createDataFrame([("c", "r1", "a.go", "must_find", "leak", "medium", None), ("c", "r2", "b.go", "must_find", "race", "critical", None), ("c", "r3", "c.go", "must_find", "lost", None, None), ("c", "r4", "a.go", "must_not", "style", None, None)], "case string, rule_id string, key string, kind string, match string, min_severity string, max_severity string")
    issues = spark.createDataFrame([("c", 1, "a.go:F", "a.go", "high", "A leak"), ("c", 2, "b.go", "b.go", "low", "race here"), ("c", 3, "a.go:G", "a.go", "low", "style nit"), ("c", 4, "z.go", "z.go", "low", "other")], "case string, issue_id int, unit_id string, file string, severity string, title string")
    by_rule, by_issue = evaluation.findings(rules, issues)
    assert {r["rule_id"]: r["outcome"] for r in by_rule.collect()} == {"r1": "found", "r2": "wrong severity", "r3": "missed", "r4": "found"}
    assert {r["issue_id"]: r["verdict"] for r in by_issue.collect()} == {1: "true positive", 2: "unlabelled", 3: "false positive", 4: "unlabelled"}
    assert evaluation.precision(by_issue).first()["precision"] == 0.5


@pytest.mark.parametrize(
    "pattern, path, want",
    [("**/migrations/**", "a/migrations/1.sql", True), ("**/migrations/**", "migrations/1.sql", True), ("*.go", "a/b.go", False), ("**/*.go", "b.go", True), ("a/{x,y}.go", "a/y.go", True), ("a/{x,y}.go", "a/z.go", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("{a", "{a", True), ("x.go", "xxgo", False)],
)
def test_map_globs(spark, pattern, path, want):
    assert one(spark, F.lit(path).rlike(patterns.map_glob(pattern))) is want


@pytest.mark.parametrize("pattern, path, want", [("*.lock", "a/b.lock", True), ("vendor/", "x/vendor/y.go", True), ("vendor/", "vendors/y.go", False), ("/a/*.go", "a/b.go", True), ("a/**/c", "a/c", True), ("a/*.go", "x/a/b.go", False), ("go.sum", "sub/go.sum", True)])
def test_policy_globs(spark, pattern, path, want):
    assert one(spark, patterns.policy_glob(pattern)(F.lit(path))) is want


def test_scalars(spark):
    assert one(spark, scalars.round_half_away(F.lit(2.5))) == 3 and one(spark, scalars.round_half_away(F.lit(-2.5))) == -3 and one(spark, scalars.round_half_away(F.lit(1.005), 2)) == 1.0
    assert one(spark, scalars.ancestors(F.lit("a/b/c"))) == ["a", "a/b"] and one(spark, scalars.ancestors(F.lit("a"))) == []
    assert one(spark, scalars.greedy_fill(F.array(*map(F.lit, [5, 9, 4, 1])), 10)) == [True, False, True, True]
    assert one(spark, scalars.pack(F.array(*map(F.lit, [5, 9, 4, 1])), 10)) == [0, 1, 2, 2]
    assert one(spark, scalars.normal_symbol(F.lit("(*T).M"))) == "T.M" and one(spark, scalars.short_name(F.lit("(T).M"))) == "M"
    assert one(spark, scalars.tally(F.array(*map(F.lit, [0.4, 20.3, 0.5])))) == 21
    assert one(spark, patterns.commit_kind(F.lit("fix typo"))) == "" and one(spark, patterns.commit_kind(F.lit("Fixes crash"))) == "fix"


def test_reach_and_callers(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b"), ("c", "a"), ("t", "c"), ("u", "t")], "src string, dst string")
    starts = spark.createDataFrame([("c", "c")], "sid string, node string")
    got = {r["node"]: r["hop"] for r in graph.reach(starts, edges).collect()}
    assert got == {"c": 0, "b": 1, "t": 1, "a": 2, "x": 2, "u": 2}
    callers = graph.direct_callers(edges, spark.createDataFrame([("b",), ("t",)], "node string"))
    assert {(r["node"], r["caller"]) for r in callers.collect() if r["node"] == "c"} == {("c", "a"), ("c", "x"), ("c", "u")}
    seeds = spark.createDataFrame([("c", "db", 65)], "node string, tag string, score int")
    assert {r["node"]: r["score"] for r in graph.propagate(seeds, edges, 1, 0.1).collect()} == {"c": 65, "b": 59, "t": 59}


def test_joins(spark):
    a = spark.createDataFrame([(1, i, i + 3) for i in range(0, 200, 2)], "k int, lo int, hi int")
    b = spark.createDataFrame([(1, i, i + 50) for i in range(0, 200, 7)], "k int, lo2 int, hi2 int")
    plain = joins.overlap_join(a, b, ["k"], ("lo", "hi"), ("lo2", "hi2"))
    binned = joins.overlap_join(a, b, ["k"], ("lo", "hi"), ("lo2", "hi2"), width=10)
    assert sorted(plain.collect()) == sorted(binned.collect())
    got = joins.longest_prefix(spark.createDataFrame([("a/b/c",), ("ab/c",)], "p string"), "p", spark.createDataFrame([("a",), ("a/b",), ("ab/cd",)], "m string"), "m")
    assert {r["p"]: r["m"] for r in got.collect()} == {"a/b/c": "a/b", "ab/c": None}
    some = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["z"])], "id int, c array<string>")
    assert {r["id"]: r["n"] for r in joins.first_existing(some, ["id"], "c", spark.createDataFrame([("a",), ("b",)], "n string"), "n").collect()} == {1: "b", 2: None}


def test_hierarchy(spark):
    dirs = spark.createDataFrame([("r", None), ("r/a", None), ("r/a/b", 5.0), ("r/a/b/c", 9.0), ("r/d", 3.0), ("r/e", None)], "dir string, rank double")
    got = {r["dir"]: r["rank"] for r in hierarchy.rank_from_children(dirs).collect()}
    assert got == {"r": 5.0, "r/a": 5.0, "r/a/b": 5.0, "r/a/b/c": 9.0, "r/d": 3.0, "r/e": None}
    tags = spark.createDataFrame([(1, 60, "a"), (1, 45, "b"), (1, 20, "c"), (2, 5, "d")], "s int, score int, tag string")
    assert {r["s"]: r["rollback"] for r in hierarchy.rollback_score(tags, ["s"]).collect()} == {1: 63, 2: 10}


def test_islands_keep_rows_without_a_value(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", None, "a", "b", None, "a"])], "k int, i int, v string")
    assert [r["island"] for r in windows.islands(rows, ["k"], [F.col("i")], "v").orderBy("i").collect()] == [1, 1, 1, 1, 2, 2, 3]


def test_log_and_map_files(spark, tmp_path):
    text = "h1\x1f1700000000\x1fAnn@X\x1fadd\nA\ta.go\nM\tb.go\n\x1eshort\x1eh2\x1f1700000001\x1fb@x\x1ffix\nR100\told.go\tnew.go\n"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text.split("\x1e"))], "seq bigint, value string")
    got = parse_log(rows, "value").orderBy("seq").collect()
    assert [(r["hash"], r["email"], [(f["status"], f["path"]) for f in r["files"]]) for r in got] == [("h1", "ann@x", [("A", "a.go"), ("M", "b.go")]), ("h2", "b@x", [("R", "new.go")])]
    write_map(records(spark).withColumn("callers", F.lit(0).cast("bigint")), f"{tmp_path}/map")
    back = read_map(spark, f"{tmp_path}/map")
    assert back.filter("repo = 'svc'").count() == 5 and {r["level"]: r["count"] for r in counts(back).collect()}["symbol"] == 2


def test_build_map(spark):
    log, ref = commits(spark)
    nodes = spark.createDataFrame([("k1", "r", "sync.go", "Run", 1, 9, 6, 2), ("k2", "r", "pkg/a.go", "A", 1, 5, 1, 1), ("k3", "r", "pkg/sub/b.go", "B", 1, 5, 1, 1)], "key string, repo string, file string, sym string, start int, end int, cyclo int, nest int")
    edges = spark.createDataFrame([("k1", "k2", 3), ("k2", "k3", 1), ("k1", "k3", 1)], "src string, dst string, n int")
    made = build_map(nodes, edges, log, [{"id": "sub", "score": 60, "floor": 50, "path": ["pkg/sub/**"]}], ref).cache()
    by = {r["id"]: r for r in made.collect()}
    assert set(by) == {"r", "r/pkg/", "r/pkg/sub/", "r/sync.go", "r/pkg/a.go", "r/pkg/sub/b.go", "r/sync.go:Run", "r/pkg/a.go:A", "r/pkg/sub/b.go:B"}
    assert by["r/pkg/sub/b.go"]["impact"] >= 50 and by["r/sync.go"]["likelihood"] > by["r/pkg/a.go"]["likelihood"]
    assert [r["id"] for r in top_records(made, "impact", 1, "file").collect()] == ["r/pkg/sub/b.go"]
