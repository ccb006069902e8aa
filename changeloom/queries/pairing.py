"""Pairs by shared postings over the lines and words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import pairing
from changeloom.operators.context import BLANK, LEAST_LINES, telling
from changeloom.queries import query, table

_BLANK = " || ".join(f"chr({ord(c)})" for c in BLANK)
_LINES = f"""
SELECT DISTINCT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {_BLANK}) AS line FROM documents)
WHERE strlen(line) >= 12 AND NOT starts_with(line, '//')"""


def _lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("doc_id", telling(F.col("line")).alias("line")).filter("line IS NOT NULL")


@query(f"""
WITH x AS MATERIALIZED ({_LINES}),
s AS (SELECT doc_id, line FROM x JOIN (SELECT line FROM x GROUP BY line HAVING count(*) > 1) USING (line)),
c AS (SELECT doc_id, list(line ORDER BY line) AS lines FROM s GROUP BY doc_id),
r AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS copies, lines FROM c GROUP BY lines),
y AS MATERIALIZED (SELECT rep, copies, unnest(lines) AS line FROM r)
SELECT a.rep AS a, b.rep AS b, count(*)::INTEGER AS shared, a.copies AS copies_a, b.copies AS copies_b
FROM y a JOIN y b ON a.line = b.line AND a.rep < b.rep GROUP BY ALL HAVING count(*) >= 3""")
def shared_line_pairs(spark, sf):
    """Classes of documents with the same shared lines, in pairs that have at least three telling lines in common."""
    posted = _lines(spark, sf).select("doc_id", pairing.token(F.col("line")).alias("tok"))
    return pairing.shared_pairs(posted, "doc_id", "tok", LEAST_LINES)
