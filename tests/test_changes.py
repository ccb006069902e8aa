"""Changes, contracts, reports, texts and trees on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from changeloom.functions import patterns, texts
from changeloom.operators import change, decisions, graph, reports
from changeloom.plans.triage import presort
from changeloom.sources import commits, trees


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    "path, first",
    [
        ("web/a.ts", "web/a.test.ts"), ("src/main/java/x/Foo.java", "src/test/java/x/FooTest.java"), ("Foo.java", None), ("pkg/a.py", "pkg/test_a.py"), ("a.py", "test_a.py"),
        ("src/Acme.Orders/Svc/Foo.cs", "src/Acme.Orders/Svc/FooTests.cs"), ("crate/src/a/foo.rs", "crate/src/a/foo_tests.rs"), ("src/main/kotlin/x/Foo.kt", "src/test/kotlin/x/FooTest.kt"),
        ("lib/shop/foo.rb", "spec/shop/foo_spec.rb"), ("app/models/foo.rb", "spec/models/foo_spec.rb"), ("Sources/Orders/Foo.swift", "Tests/OrdersTests/FooTests.swift"), ("lib/src/foo.dart", "test/src/foo_test.dart"),
        ("src/Orders/Foo.php", "tests/Orders/FooTest.php"), ("a/b.psm1", "a/b.Tests.ps1"), ("a/b.cc", "a/b_test.cc"), ("a/b.txt", None),
    ],
)
def test_candidates_of_languages(spark, path, first):
    got = one(spark, c=patterns.test_candidates(F.lit(path)))["c"]
    assert (got[0] if got else None) == first


def test_more_candidates(spark):
    got = lambda p: one(spark, c=patterns.test_candidates(F.lit(p)))["c"]
    assert got("src/Acme.Orders/Svc/Foo.cs")[2:] == ["tests/Acme.Orders.Tests/Svc/FooTests.cs", "test/Acme.Orders.Tests/Svc/FooTests.cs", "Acme.Orders.Tests/Svc/FooTests.cs"]
    assert got("crate/src/a/foo.rs")[1:] == ["crate/src/a/foo/tests.rs", "crate/tests/foo.rs"]


def test_test_gaps(spark):
    files = spark.createDataFrame([(1, "a/x.go", "modified"), (1, "b/y.go", "modified"), (1, "b/y_test.go", "modified"), (1, "w/z.ts", "modified"), (1, "w/v.ts", "modified"), (1, "w/v.test.ts", "modified"), (1, "w/n.ts", "added"), (1, "c/d.go", "deleted")], "change_id int, path string, status string")
    known = spark.createDataFrame([("w/z.spec.ts",), ("w/v.test.ts",)], "path string")
    assert {r["path"] for r in change.test_gaps(files, known).collect() if r["test_gap"]} == {"a/x.go", "w/z.ts"}


def test_extracted_and_auxiliary(spark):
    rows = spark.createDataFrame([("a.py", "py"), ("tests/a.py", "py"), ("venv/a.py", "py"), ("src/test/A.java", "java"), ("A.java", "java"), ("target/a.rs", "rs"), ("x.spec.ts", "ts"), ("b/Dockerfile", ""), ("requirements-dev.txt", ""), ("a.txt", ""), ("db/q.sql", "")], "path string, lang string")
    got = rows.select("path", patterns.extracted(F.col("path"), F.col("lang")).alias("e"), patterns.auxiliary(F.col("path")).alias("a")).collect()
    assert {r["path"] for r in got if not r["e"]} == {"tests/a.py", "venv/a.py", "src/test/A.java", "target/a.rs", "x.spec.ts"}
    assert {r["path"] for r in got if r["a"]} == {"b/Dockerfile", "requirements-dev.txt", "db/q.sql"}


def test_notes_and_explanations(spark):
    row = {"path": "a.go", "skipped": False, "generated": False, "status": "modified", "recent_fixes": 1.5, "reverts": 0, "recent": 0.0, "authors": 1, "dir_fixes": 0.0, "cyclo": 0, "nest": 0, "delta": 0, "changed": 10, "file_commits": 0, "repo_commits": 3, "n_missing": 0, "test_gap": False, "dirs": 1, "fix_pr": False}
    rows = [row, {**row, "path": "a_test.go"}, {**row, "path": "b.go", "skipped": True}, {**row, "path": "c.go", "repo_commits": -1, "file_commits": -1}]
    got = {r["path"]: r for r in change.change_likelihood(spark.createDataFrame(rows)).collect()}
    assert got["a.go"]["likelihood"] == 32 and [f["name"] for f in got["a.go"]["factors"]] == ["fixes", "new_to_file", "newcomer"]
    assert got["a.go"]["factors"][0]["why"] == "1.5 recency-weighted fixes" and got["c.go"]["likelihood"] == 18
    assert (got["a_test.go"]["likelihood"], got["b.go"]["likelihood"], got["b.go"]["factors"]) == (0, 0, None) and "test" in got["a_test.go"]["note"]


def test_presort_imports(spark):
    line = lambda *xs: [{"op": x[0], "text": x[1:]} for x in xs]
    rows = [("a.go", "imports", "modified", line('+"fmt"', '-"os"')), ("b.go", "imports", "modified", line('+_ "side"')), ("c.go", "", "modified", line("+package x")), ("d.py", "imports", "modified", line('+"fmt"')), ("go.sum", "", "modified", line("+x"))]
    df = spark.createDataFrame(rows, "file string, symbol string, status string, lines array<struct<op: string, text: string>>")
    got = {r["file"]: r["rule"] and (r["rule"]["bucket"], r["rule"]["change_kind"]) for r in presort(df).collect()}
    assert got == {"a.go": ("none", "format"), "b.go": None, "c.go": ("none", "format"), "d.py": None, "go.sum": ("none", "generated")}


def test_rescore_of_older_rows(spark):
    schema = "id int, prior int, base int, pin string, floor string, attention int, clean double, bucket string, escalated array<string>, reviewed boolean, review_failed boolean, severities array<string>, impact int, likelihood int, change_kind string, source string, confidence double, risk_signals array<string>, chars int"
    old = (None, None, None, None, None, None)
    rest = (64, 36, "behavior", "model", 0.9, [], 10)
    rows = [(1, *old, "skim", [], False, False, [], *rest), (2, *old, "skim", ["summarizer: no"], False, False, [], *rest), (3, *old, "skim", [], True, False, [], *rest), (4, 7, 7, None, None, 3, 0.5, "skim", [], False, False, [], *rest), (5, *old, None, [], False, False, [], *rest)]
    got = {r["id"]: r for r in decisions.rescore(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["prior"] for i in range(1, 6)] == [48, 48, 48, 7, None]
    assert got[2]["pin"] == "human" and got[1]["pin"] is None and (got[1]["clean"], got[3]["clean"], got[4]["attention"]) == (0.0, 1.0, 3)


def test_texts(spark):
    t = F.lit("host/o/r.git#12")
    row = one(spark, a=texts.change_reference(t, "h"), b=texts.change_reference(F.lit("git.example.com/o/r.git#12"), "h"), c=texts.change_reference(F.lit("nothing"), "h"))
    assert row["a"] is None and row["b"].asDict() == {"host": "git.example.com", "owner": "o", "repo": "r", "number": 12} and row["c"] is None
    constants = F.create_map(F.lit("a"), F.lit("x${b}"), F.lit("b"), F.lit("y"), F.lit("loop"), F.lit("${loop}"))
    row = one(spark, a=texts.expanded(F.lit("/${a}/${c}/z"), constants), b=texts.expanded(F.lit("plain"), constants), c=texts.expanded(F.lit("p${loop}q"), constants))
    assert (row["a"], row["b"], row["c"]) == ("/xy/{}/z", "plain", "pq")
    row = one(spark, a=texts.service_urls(F.lit("'/shop/v1/x' and '/alone' or https://h.org/api/y?z=1")), d=texts.common_depth(F.lit("a/b/c.go"), F.lit("a/b/d/e.go")))
    assert [(x["service"], x["path"]) for x in row["a"]] == [("shop", "/v1/x"), ("api", "/y")] and row["d"] == 2


def test_text_slots(spark):
    unit = spark.createDataFrame([(("h", "s", ["f1", "f2"], ["i"]), ("H", "", ["F1", ""], ["I", "J"]))], "u struct<headline: string, summary: string, focus: array<string>, issues: array<string>>, t struct<headline: string, summary: string, focus: array<string>, issues: array<string>>")
    row = unit.select(texts.slots(F.col("u")).alias("s"), texts.applied(F.col("u"), F.col("t")).alias("a")).first()
    assert [tuple(x) for x in row["s"]] == [("headline", "h"), ("summary", "s"), ("focus.0", "f1"), ("focus.1", "f2"), ("issues.0", "i")]
    assert tuple(row["a"]) == ("H", "s", ["F1", "f2"], ["i"])


def test_trees(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "repo string, path string, text string")
    got = trees.modules(files([("r", "a/go.mod", "// x\nmodule example.com/a\n\ngo 1"), ("r", "go.mod", "module m"), ("r", "old/go.mod", "module o"), ("r", "b/go.mod", "nothing")]), ["^old"])
    assert {tuple(r) for r in got.collect()} == {("r", "a", "example.com/a"), ("r", "", "m")}
    got = trees.generated_attributes(spark.createDataFrame([("r", "# c\n*.pb.go linguist-generated\na.txt text\ndocs/*  linguist-generated=true eol=lf\n")], "repo string, text string"))
    assert [r["pattern"] for r in got.orderBy("ord").collect()] == ["*.pb.go", "docs/*"]
    listed = trees.listing(files([("r", "a", ""), ("r", "a", ""), ("r", "b", "")]), files([("r", "a", "")]))
    assert [tuple(r) for r in listed.collect()] == [("r", "a")]
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "x" / "a.go").write_text("package x")
    head = trees.read_files(spark, f"{tmp_path}/t", "*.go")
    assert [(r["path"], bytes(r["content"])) for r in head.collect()] == [("x/a.go", b"package x")]
    sides = trees.contents(spark.createDataFrame([("x/a.go", "x/b.go", "renamed")], "path string, old_path string, status string"), head, head.limit(0)).first()
    assert bytes(sides["head_content"]) == b"package x" and sides["base_content"] is None


def test_caches(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", 1), ("s", "b", 2)], "repo string, key string, n int")
    trees.write_graph(rows, f"{tmp_path}/g", 3)
    trees.write_graph(rows.filter("repo = 's'").withColumn("n", F.lit(5)), f"{tmp_path}/g", 3)
    assert {(r["repo"], r["n"]) for r in trees.read_graph(spark, f"{tmp_path}/g", "key STRING, n INT", 3).collect()} == {("r", 1), ("s", 5)}
    assert trees.read_graph(spark, f"{tmp_path}/g", "key STRING, n INT", 4).count() == 0
    entry = lambda *xs: spark.createDataFrame([(x, v) for x, v in xs], "key string, v int")
    got = trees.replaced_cache(entry(("a", 1), ("b", 1), ("c", 1)), entry(("b", 2)), entry(("a", 0), ("b", 0)), ["key"])
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2)}


def test_fixtures_and_policy(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"diff": "x.diff", "labels": {"a.go": "human"}, "must_find": [{"unit": "a.go", "match": "race"}]}))
    row = trees.eval_cases(spark, f"{tmp_path}/one.json").first()
    assert row["case"] == "one" and row["labels"] == {"a.go": "human"} and row["must_find"][0]["match"] == "race"
    (tmp_path / "two.json").write_text(json.dumps({"name": "two", "labels": {}}))
    with pytest.raises(Exception, match="give one of"):
        trees.eval_cases(spark, f"{tmp_path}/two.json").collect()
    (tmp_path / "meta.json").write_text(json.dumps({"version": 1, "levels": {"high": 55}, "rules": [{"id": "a", "score": 3}], "repos": {"r": {"commit": "c", "dirty": False}}}))
    assert trees.metadata(spark, f"{tmp_path}/meta.json").first()["repos"]["r"]["commit"] == "c"
    assert [r["id"] for r in trees.path_rules([{"id": "a", "path": ["x"]}, {"id": "b", "kind": ["func"]}, {"id": "c", "exported": False}, {"id": "d", "tags": []}])] == ["a", "d"]
    merged = trees.merged_policy({"force_human": ["a"], "max_chars": 10, "budgets": {"most": {"human": 1, "skim": 2}}}, {"force_human": ["b"], "max_chars": 0, "budgets": {"most": {"skim": 5}}})
    assert merged == {"force_human": ["a", "b"], "max_chars": 10, "budgets": {"most": {"human": 1, "skim": 5}}}
    with pytest.raises(ValueError, match="unknown"):
        trees.merged_policy({}, {"x": 1})


def test_long_commits_and_callers_on_a_cycle(spark):
    files = "\n".join(f"M\tf{i}" for i in range(5))
    row = commits.parse_log(spark.createDataFrame([(f"h\x1f100\x1fA@b\x1fs\n{files}", 0)], "value string, seq long"), "value").first()
    assert len(row["files"]) == 5 and row["email"] == "a@b"
    edges = spark.createDataFrame([("c", "b"), ("b", "c"), ("d", "b")], "src string, dst string")
    got = graph.direct_callers(edges, spark.createDataFrame([("b",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("b", "c"), ("b", "d"), ("c", "d")}


def test_propagation_leaves_silent_nodes_out(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "t", 50)], "node string, tag string, score int")
    got = graph.propagate(seeds, edges, 3, 0.1, spark.createDataFrame([("b",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("a", "t", 50, 0), ("c", "t", 40, 2)}


def test_json_report(spark):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert json.loads(reports.as_json(df, ["id"]).first()["json"]) == {"id": 1, "v": "x"}
