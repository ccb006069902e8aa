"""Impact of units by every name they touch."""

from changeloom.plans.impact import touched, unit_impacts
from changeloom.sources.diffs import parse_diff, units
from tests.test_operators import records
from tests.test_triage import DECLARATIONS

MAP = [
    ("svc", "repo", "svc", "", None, None, 30, 40.0, 10, None),
    ("svc/svc/", "dir", "svc", "svc", None, None, 20, 30.0, 10, None),
    ("svc/svc/hot.go", "file", "svc", "svc/hot.go", None, None, 80, 99.0, 70, None),
    ("svc/svc/hot.go:Hot", "symbol", "svc", "svc/hot.go", "Hot", [3, 8], 82, 99.0, 70, None),
    ("svc/svc/hot.go:Warm", "symbol", "svc", "svc/hot.go", "Warm", [40, 50], 50, 60.0, 30, None),
    ("svc/svc/ui.ts", "file", "svc", "svc/ui.ts", None, None, 40, 50.0, 10, None),
    ("svc/svc/ui.ts:B", "symbol", "svc", "svc/ui.ts", "B", [90, 99], 44, 60.0, 10, None),
    ("svc/api/v1/user/api.yaml", "file", "svc", "api/v1/user/api.yaml", None, None, 70, 90.0, 55, None),
    ("svc/api/v1/user/api.yaml:GetB", "symbol", "svc", "api/v1/user/api.yaml", "GetB", [400, 420], 72, 91.0, 55, None),
]
BASE = [("svc/hot.go", "imports", 1, 2, 0), ("svc/hot.go", "Other", 3, 5, 1), ("svc/hot.go", "Hot", 9, 12, 2), ("svc/hot.go", "Warm", 20, 29, 3), ("svc/ui.ts", "A", 3, 3, 0), ("svc/ui.ts", "B", 5, 7, 1), ("api/v1/user/api.yaml", "GetA", 4, 6, 0), ("api/v1/user/api.yaml", "GetB", 8, 10, 1)]
HOT, FILE = "svc/svc/hot.go:Hot", "svc/svc/hot.go"

# name, path, status, the unit's name, points, whether there is a base side: matched, basis
CASES = [
    ("its own name", "svc/hot.go", "modified", "Hot", [(10, 10)], True, "symbol", HOT),
    ("no name of a declaration", "svc/hot.go", "modified", "func X() {", [(10, 10)], True, "symbol", HOT),
    ("renamed declaration", "svc/hot.go", "modified", "HotRenamed", [(9, 9)], True, "symbol", HOT),
    ("a declaration without a record, whatever the map's lines say", "svc/hot.go", "modified", "func X() {", [(4, 4)], True, "file", FILE),
    ("new declaration after another", "svc/hot.go", "modified", "NewHelper", [(12, 13)], True, "file", FILE),
    ("put in within", "svc/hot.go", "modified", "func X() {", [(10, 11)], True, "symbol", HOT),
    ("script", "svc/ui.ts", "modified", "", [(6, 6)], True, "symbol", "svc/svc/ui.ts:B"),
    ("imports of a script", "svc/ui.ts", "modified", "", [(1, 1)], True, "file", "svc/svc/ui.ts"),
    ("operation", "api/v1/user/api.yaml", "modified", "", [(9, 9)], True, "symbol", "svc/api/v1/user/api.yaml:GetB"),
    ("no base: the map's lines", "svc/hot.go", "modified", "func X() {", [(4, 4)], False, "symbol", HOT),
    ("a file without names", "svc/q.sql", "modified", "", [(2, 2)], True, "dir", "svc/svc/"),
    ("new file", "svc/hot2.go", "added", "Hot", [], True, "dir", "svc/svc/"),
    ("new file that the map has", "svc/hot.go", "added", "Hot", [], True, "dir", "svc/svc/"),
    ("imports of Go aren't a name", "svc/hot.go", "modified", "imports", [(1, 1)], True, "file", FILE),
]
UNIT = "change_id string, id string, file string, old_path string, status string, symbol string, points array<struct<a: int, b: int>>, old_lo int, old_hi int"


def unit(name, path, status, symbol, points, *_):
    return (name, "u", path, path, status, symbol, points, min((a for a, _ in points), default=None), max((b for _, b in points), default=None))


def test_names_on_the_base(spark):
    book = spark.createDataFrame(MAP, records(spark).schema)
    for there in (True, False):
        some = [c for c in CASES if c[5] is there]
        base = spark.createDataFrame([(c[0], *b) for c in some for b in BASE], DECLARATIONS) if there else None
        found = unit_impacts(spark.createDataFrame([unit(*c) for c in some], UNIT), base, book, [], "svc")
        assert {r["change_id"]: (r["matched"], r["basis"]) for r in found.collect()} == {c[0]: c[6:] for c in some}


def test_the_highest_of_several_names_counts(spark):
    book = spark.createDataFrame(MAP, records(spark).schema)
    base = spark.createDataFrame([("c", *b) for b in BASE], DECLARATIONS)
    row = unit_impacts(spark.createDataFrame([unit("c", "svc/hot.go", "modified", "Warm", [(4, 4), (11, 11), (25, 25)])], UNIT), base, book, [], "svc").first()
    assert (row["impact"], row["basis"], row["also"]) == (82, HOT, ["svc/svc/hot.go:Warm"])


def test_points_of_units(spark):
    body = "@@ -10,5 +10,7 @@\n a\n-b\n+B\n+C\n c\n+D\n d\n e\n"
    text = "diff --git a/old.go b/new.go\nrename from old.go\nrename to new.go\n" + body + "diff --git a/x.go b/x.go\n@@ -4,0 +5,2 @@\n+p\n+q\n"
    files, lines = parse_diff(spark.createDataFrame([("c", text)], "change_id string, text string"))
    got = {r["id"]: r for r in units(files, lines, spark.createDataFrame([], DECLARATIONS)).collect()}
    pairs = lambda k: [(p["a"], p["b"]) for p in got[k]["points"]]
    assert pairs("new.go") == [(11, 11), (12, 13)] and got["new.go"]["old_path"] == "old.go" and (got["new.go"]["old_lo"], got["new.go"]["old_hi"]) == (10, 14)
    assert pairs("x.go") == [(4, 5)] and (got["x.go"]["old_lo"], got["x.go"]["old_hi"]) == (5, 6)


def test_innermost_across_bins(spark):
    decl = spark.createDataFrame([("f", "Class", 1, 500, 0), ("f", "Class.m", 100, 200, 1), ("f", "Class.n", 100, 200, 2)], "path string, name string, start int, end int, ord int")
    points = spark.createDataFrame([("u", "f", 150, 150), ("u", "f", 300, 301), ("u", "f", 200, 201), ("v", "f", 501, 501)], "id string, path string, a int, b int")
    assert [(r["id"], r["names"]) for r in touched(points, decl, ["id"], ["path"]).collect()] == [("u", ["Class", "Class.m"])]
