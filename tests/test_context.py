"""URL contracts and review context."""

from pyspark.sql import functions as F

from changeloom.operators.context import review_context
from changeloom.operators.contracts import client_edges, url_edges


def test_urls(spark):
    ops = spark.createDataFrame([("svc", "get", ["/api/v1"], "/users/{id}"), ("svc", "list", ["/api/v1"], "/users"), ("svc", "any", [], "/{a}/{b}"), ("svc", "other", ["/x"], "/users/{id}")], "service string, key string, servers array<string>, op_path string")
    refs = spark.createDataFrame([("a", "svc", "/api/v1/users/{}"), ("b", "svc", "/v2/users"), ("c", "svc", "/nothing"), ("d", "none", "/users")], "src string, service string, path string")
    got = sorted((r["src"], r["dst"], r["score"]) for r in url_edges(refs, ops).collect())
    assert got == [("a", "get", 31), ("b", "list", 11)]


def test_clients(spark):
    nodes = spark.createDataFrame([("n1", "r", "d", "(*Client).GetUser"), ("n2", "r", "d", "Other")], "key string, repo string, dir string, sym string")
    ops = spark.createDataFrame([("r", "d", "op1", "get-user")], "repo string, dir string, key string, name string")
    assert [(r["src"], r["dst"]) for r in client_edges(nodes, ops, r"\(\*Client\)\.(\w+)").collect()] == [("n1", "op1")]


def test_review_context(spark):
    line = lambda op, text: {"line_ord": 1, "op": op, "text": text}
    moved = [f"result := compute{i}(input)" for i in range(3)]
    rows = [
        ("c", "a.go:F", "a.go", "F", [line("+", m) for m in moved] + [line("+", "Helper()")], False, 0),
        ("c", "b.go:G", "b.go", "G", [line("-", m) for m in moved], False, 1),
        ("c", "c.go:Helper", "c.go", "Helper", [line("+", "x")], False, 2),
        ("c", "a.go:Z", "a.go", "Z", [line("+", "y" * 50)], False, 3),
        ("c", "go.sum", "go.sum", "", [line("+", "z")], True, 4),
    ]
    units = spark.createDataFrame(rows, "change_id string, id string, file string, symbol string, lines array<struct<line_ord: int, op: string, text: string>>, skipped boolean, ord int")
    got = {r["id"]: r for r in review_context(units).collect()}["a.go:F"]
    assert got["shown"] == ["b.go:G", "c.go:Helper", "a.go:Z"] and got["hidden"] == ["go.sum"]
    assert [(m["id"], m["lines"]) for m in got["moved"]] == [("b.go:G", 3)]
    tight = review_context(units, room=95).filter(F.col("id") == "a.go:F").first()
    assert tight["shown"] == ["b.go:G", "c.go:Helper"] and tight["hidden"] == ["a.go:Z", "go.sum"]
