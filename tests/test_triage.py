"""Triage of whole diffs: a unit for every file, every rule, and what is a test."""

from changeloom.functions.patterns import is_test
from changeloom.plans.triage import triage
from changeloom.sources.diffs import parse_diff, units
from tests.test_operators import RULES, records

FIVE = """diff --git a/svc/retry.go b/svc/retry.go
--- a/svc/retry.go
+++ b/svc/retry.go
@@ -1,9 +1,9 @@ package svc
 package svc
 
 // Retry calls fn.
 func Retry(fn func() error) error {
-	for i := 0; i < 3; i++ {
+	for i := 0; i < 5; i++ {
 		if err := fn(); err == nil {
 			return nil
 		}
 	}
diff --git a/go.sum b/go.sum
--- a/go.sum
+++ b/go.sum
@@ -1 +1 @@
-a v1
+a v2
diff --git a/old/name.go b/new/name.go
similarity index 100%
rename from old/name.go
rename to new/name.go
diff --git a/db/migrations/001.sql b/db/migrations/001.sql
new file mode 100644
--- /dev/null
+++ b/db/migrations/001.sql
@@ -0,0 +1 @@
+CREATE TABLE t (id int);
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
"""

DECLARATIONS = "change_id string, path string, name string, start int, end int, ord int"
ANSWERS = "change_id string, id string, bucket string, change_kind string, confidence double"
ISSUES = "change_id string, id string, severity string"


def result(spark, text, **tables):
    empty = lambda schema: spark.createDataFrame([], schema)
    found = triage(spark.createDataFrame([("c", text)], "change_id string, text string"), empty(DECLARATIONS), records(spark), RULES, "svc", tables.pop("answers", empty(ANSWERS)), empty(ISSUES), **tables)
    return {r["id"]: r for r in found.collect()}


def test_five_files(spark):
    got = {k: v["bucket"] for k, v in result(spark, FIVE, answers=spark.createDataFrame([("c", "svc/retry.go", "none", "format", 0.99)], ANSWERS)).items()}
    assert got == {"go.sum": "none", "new/name.go": "none", "db/migrations/001.sql": "human", "logo.png": "human", "svc/retry.go": got["svc/retry.go"]}
    assert got["svc/retry.go"] == "none"  # a model said so, no rule
    assert result(spark, FIVE)["svc/retry.go"]["bucket"] == "human"


def file(path, *lines, status=""):
    return f"diff --git a/{path} b/{path}\n{status}--- a/{path}\n+++ b/{path}\n@@ -1,2 +1,2 @@\n" + "\n".join(lines) + "\n"


def test_all_rules_fire(spark):
    text = FIVE + file("marked.ts", "+a") + file("head.py", "+b") + file("space.c", "-x  y", "+x y") + file("imports.go", ' import "a"', '+import "b"') + file("package.go", "-package a", "+package b") + file("README.md", "+words") + file("plain.py", "+code")
    table = lambda schema, *rows: spark.createDataFrame(rows, schema)
    decl = table(DECLARATIONS, ("c", "imports.go", "imports", 1, 2, 0))
    paths = ["marked.ts", "head.py", "imports.go", "package.go", "README.md", "plain.py", "svc/retry.go", "go.sum", "db/migrations/001.sql"]
    df = spark.createDataFrame([("c", text)], "change_id string, text string")
    options = {"marked": table("change_id string, path string", ("c", "marked.ts")), "heads": table("change_id string, path string, head string", ("c", "head.py", "# Code generated by x. DO NOT EDIT.\n")), "real": table("change_id string, path string", *[("c", p) for p in paths])}
    got = {r["id"]: r["bucket"] for r in triage(df, decl, records(spark), RULES, "svc", table(ANSWERS, ("c", "none", "none", "format", 1.0)), table(ISSUES, ("c", "none", "high")), **options).collect()}
    none = {"go.sum", "new/name.go", "marked.ts", "head.py", "space.c", "imports.go:imports", "package.go"}
    assert {k for k, v in got.items() if v == "none"} == none
    assert got["README.md"] == "skim" and {k for k, v in got.items() if v == "human"} == {"db/migrations/001.sql", "logo.png", "plain.py", "svc/retry.go"}


def test_added_and_deleted_files_are_whole(spark):
    body = [f"+line {i}" for i in range(8)]
    text = file("new.go", *body, status="new file mode 100644\n").replace("-1,2 +1,2", "-0,0 +1,8") + file("gone.go", *[f"-{x}" for x in "abc"], status="deleted file mode 100644\n")
    files, lines = parse_diff(spark.createDataFrame([("c", text)], "change_id string, text string"))
    decl = spark.createDataFrame([("c", "new.go", "A", 1, 4, 0), ("c", "new.go", "B", 5, 8, 1), ("c", "gone.go", "G", 1, 9, 0)], DECLARATIONS)
    assert {r["id"]: r["line"] for r in units(files, lines, decl).collect()} == {"new.go": 1, "gone.go": 1}
    assert {r["id"] for r in units(files, lines, decl, most=20).collect()} == {"new.go:A", "new.go:B", "gone.go"}


def test_what_is_a_test(spark):
    cases = {
        "spec/shop/orders_spec.rb": True, "lib/shop/orders.rb": False, "app/src/test/kotlin/A.kt": True, "Tests/OrdersTests/ATests.swift": True, "test/order_test.dart": True, "tests/Unit/ATest.php": True,
        "src/order_test.cc": True, "src/order.cc": False, "src/Orders.Tests.ps1": True, "src/tests.rs": True, "src/a_test.rs": True, "benches/b.rs": True, "pkg/conftest.py": True, "X.Tests/Y.cs": True, "test/Y.cs": True,
        "test/a.go": False, "spec/a.go": False, "a_test.go": True, "testdata/x.go": True, "a/testdata/x.json": True, "a.test.ts": True, "a.spec.jsx": True, "tests/a.ts": False, "__tests__/a.ts": True, "src/it/AIT.java": True, "test/A.java": False,
        "src/test/A.java": True, "tests/a.py": True, "test/a.py": False, "a/test_x.py": True, "run_test.sh": True, "test_run.bash": True, "integration_test/a.dart": True, "A.CC": False, "specs/a.H": True, "a/FooTest.cpp": True, "Latest.php": False, "contest.kt": False, "contests/x.c": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r["path"]: r["t"] for r in rows.withColumn("t", is_test(rows["path"])).collect()} == cases


def test_unsure_answers_go_one_bucket_up(spark):
    answer = lambda confidence: spark.createDataFrame([("c", "svc/retry.go", "none", "refactor", confidence)], ANSWERS)
    sure, unsure, cut = result(spark, FIVE, answers=answer(0.99)), result(spark, FIVE, answers=answer(0.5)), result(spark, FIVE, answers=answer(0.99), most_chars=10)
    prior = lambda x: x["svc/retry.go"]["prior"]
    assert prior(sure) < prior(unsure) == prior(cut)  # "none" weighs at most 0.3, a refactoring that is skimmed 0.6


def test_impact_by_base_names_in_triage(spark):
    text = file("dao/q.go", " a", "-b", "+c")
    decl = "change_id string, path string, name string, start int, end int, ord int"
    base = spark.createDataFrame([("c", "dao/q.go", "(*Queries).Insert", 2, 4, 0)], decl)
    with_base, without = result(spark, text, base=base), result(spark, text)
    assert with_base["dao/q.go"]["impact"] == 80 and without["dao/q.go"]["impact"] == 65  # the map's lines say nothing of line 2
