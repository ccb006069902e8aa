"""Histories as graphs of commits, made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.history import advance
from changeloom.queries import query, table


def _commits(spark, sf) -> DataFrame:
    """Each nation's orders as commits: two lines side by side, merged now and then."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    met = orders.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy("o_orderdate", "o_orderkey")
    rows = met.select(F.col("c_nationkey").alias("repo"), F.col("o_orderkey").alias("hash"), F.row_number().over(w).alias("i"), F.lag("o_orderkey", 1).over(w).alias("one"), F.lag("o_orderkey", 2).over(w).alias("two"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("n"))
    merge = F.when((F.col("hash") % 500 == 0) | F.col("two").isNull(), F.col("one"))
    return rows.select("repo", "hash", "i", "n", (-F.col("i")).alias("seq"), F.array_compact(F.array("two", merge)).alias("parents"))


@query("""
WITH RECURSIVE o AS MATERIALIZED (SELECT c_nationkey AS repo, o_orderkey AS hash, row_number() OVER w AS i, lag(o_orderkey, 1) OVER w AS one, lag(o_orderkey, 2) OVER w AS two, count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey)),
e AS MATERIALIZED (SELECT hash, two AS parent FROM o WHERE two IS NOT NULL UNION SELECT hash, one FROM o WHERE one IS NOT NULL AND (hash % 500 = 0 OR two IS NULL)),
r AS (SELECT repo, hash FROM o WHERE i = n UNION SELECT r.repo, e.parent FROM r JOIN e USING (hash)),
m AS (SELECT o.repo, n, (o.repo, o.hash) IN (SELECT (repo, hash) FROM r) AS ancestor FROM o WHERE i = n // 2)
SELECT repo, ancestor, (CASE WHEN ancestor THEN n - n // 2 ELSE n - n // 3 END)::BIGINT AS written FROM m""")
def history_advance(spark, sf):
    """The first half of each nation's history is known, its middle commit the mark; a log of the last two thirds is read. It adds
    what is new if the mark is an ancestor of the newest commit, and replaces all if not."""
    commits = _commits(spark, sf)
    mid = F.floor(F.col("n") / 2)
    known = commits.filter(F.col("i") <= mid)
    heads = commits.filter(F.col("i") == mid).select("repo", F.col("hash").alias("old"))
    log = commits.filter(F.col("i") > F.floor(F.col("n") / 3))
    made = advance(known, heads, log.select("repo", "seq", "hash", "parents"))
    return made.groupBy("repo").agg((F.max("mode") == "append").alias("ancestor"), F.count("*").alias("written"))
