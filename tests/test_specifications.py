"""Operations read from the indentation of YAML."""

from changeloom.sources.specifications import operations, servers

SPEC = """# get: nothing
openapi: 3.0.3
info:
  description: |
    paths:
      /not/a/path:
        get:
servers:
  - url: https://x.example/v1   # first
  - description: two
    url: "/v2"
paths:
  /a/{id}:
    parameters:
    - name: id
    get:
      operationId: GetA
      description: >
        post:
          operationId: inner
    x-note:
      operationId: none
    Patch:
      responses:
        operationId: deeper
  '/b:batch':   # quoted
      delete: {summary: x, operationId: "DelB"}
      summary: y
components:
  schemas:
    get:
      operationId: no
"""


def test_operations_and_servers(spark):
    files = spark.createDataFrame([("r", "api.yaml", SPEC), ("r", "other.yaml", SPEC.replace("openapi", "other")), ("r", "end.yaml", "swagger: '2.0'\nbasePath: /v3\ncomponents: {}\npaths:\n  /z:\n    get:\n      x: 1\n"), ("r", "none.yaml", ""), ("r", "null.yaml", None)], "repo string, path string, text string")
    got = [tuple(r)[1:] for r in operations(files).orderBy("path", "start").collect()]
    line = {t.strip(): i + 1 for i, t in enumerate(SPEC.split("\n"))}
    assert got == [
        ("api.yaml", "GetA", "GET", "/a/{id}", 16, 22),
        ("api.yaml", "PATCH /a/{id}", "PATCH", "/a/{id}", 23, 26),
        ("api.yaml", "DelB", "DELETE", "/b:batch", 27, line["components:"] - 1),
        ("end.yaml", "GET /z", "GET", "/z", 6, 8),
    ]
    assert {r["path"]: r["servers"] for r in servers(files).collect()} == {"api.yaml": ["https://x.example/v1", "/v2"], "end.yaml": ["/v3"]}
