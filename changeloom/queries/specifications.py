"""Operations of specifications that are written out from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.queries import query, table
from changeloom.sources.specifications import operations

_OPS = """
WITH b AS (SELECT p_brand AS repo, 'api/' || (p_partkey // 100) || '.yaml' AS path, p_partkey AS k, p_partkey % 3 AS v, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 5 END AS n FROM part),
s AS (SELECT *, '/p/' || k AS url, 3 + coalesce(sum(n) OVER (PARTITION BY repo, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, 2 + sum(n) OVER (PARTITION BY repo, path) AS last FROM b),
o AS (
  SELECT repo, path, 'op' || k AS name, 'GET' AS method, url, pos + 1 AS start, last FROM s WHERE v = 0
  UNION ALL SELECT repo, path, 'POST ' || url, 'POST', url, pos + 3, last FROM s WHERE v = 1
  UNION ALL SELECT repo, path, 'op' || k, 'PUT', url, pos + 1, last FROM s WHERE v = 2
  UNION ALL SELECT repo, path, 'del' || k, 'DELETE', url, pos + 4, last FROM s WHERE v = 2)
SELECT repo, path, name, method, url, start::INT AS start, coalesce(lead(start) OVER (PARTITION BY repo, path ORDER BY start) - 1, last)::INT AS "end" FROM o"""


@query(_OPS)
def specification_operations(spark, sf):
    """A specification for each brand and hundred of parts, in which a part is a path with one or two operations."""
    k = F.col("p_partkey")
    text = (
        F.when(k % 3 == 0, F.format_string("  /p/%1$s:\n    get:\n      operationId: op%1$s\n", k))
        .when(k % 3 == 1, F.format_string('  "/p/%1$s":\n    parameters:\n    - name: x\n    post:\n      tags:\n      - operationId: no\n', k))
        .otherwise(F.format_string("  /p/%1$s:\n    put:\n      responses: {}\n      operationId: 'op%1$s' # put\n    delete: {operationId: del%1$s}\n", k))
    )
    parts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("repo"), F.format_string("api/%s.yaml", F.floor(k / 100)).alias("path"))
    files = parts.agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("p"))
    whole = F.concat(F.lit("openapi: 3.0.3\npaths:\n"), F.array_join(F.transform("p", lambda x: x["t"]), ""), F.lit("components:\n  x: {}\n"))
    return operations(files.select("repo", "path", whole.alias("text")))
