"""Impact by every name that is touched, on a map made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.plans.impact import unit_impacts
from changeloom.queries import query, table


def _day(column: str):
    return F.unix_date(F.col(column).cast("date")).cast("int")


@query("""
WITH o AS MATERIALIZED (
  SELECT o_orderkey AS k, o_custkey AS c, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 40 + o_orderkey % 200 AS e, o_totalprice AS p FROM orders),
pt AS (SELECT DISTINCT c, k, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_linenumber % 2 AS b FROM lineitem JOIN o ON k = l_orderkey),
inner_ AS (SELECT pt.c, pt.k, a, b, min((e - s) * 10000000000 + o.k) % 10000000000 AS d FROM pt JOIN o ON o.c = pt.c AND s <= a AND b <= e GROUP BY ALL),
sym AS (SELECT k AS d, floor(p / 5000)::INT AS impact FROM o WHERE p >= 150000),
hit AS (SELECT DISTINCT c, k, d, impact FROM inner_ JOIN sym USING (d)),
best AS (SELECT c, k, max(impact) AS impact, min(d ORDER BY d) FILTER (WHERE impact = m) AS d, count(*) - 1 AS others FROM (SELECT *, max(impact) OVER (PARTITION BY k) AS m FROM hit) GROUP BY ALL)
SELECT o.c::VARCHAR AS change_id, o.k::VARCHAR AS id,
  CASE WHEN d IS NOT NULL THEN 'symbol' WHEN c_acctbal > 0 THEN 'file' ELSE 'dir' END AS matched,
  CASE WHEN d IS NOT NULL THEN 'm/n' || c_nationkey || '/c' || o.c || '.java:o' || d WHEN c_acctbal > 0 THEN 'm/n' || c_nationkey || '/c' || o.c || '.java' ELSE 'm/n' || c_nationkey || '/' END AS basis,
  coalesce(others, 0)::INT AS n_also,
  CASE WHEN d IS NOT NULL THEN impact WHEN c_acctbal > 0 THEN floor(c_acctbal / 100)::INT ELSE floor(3.2 * c_nationkey + 0.5)::INT END AS impact
FROM o JOIN customer ON c_custkey = o.c LEFT JOIN best ON best.k = o.k""")
def impact_by_all_names(spark, sf):
    """An order is a unit of its customer's file and touches the orders whose spans hold its shipments most closely; the
    dearest with a record counts, else the customer, else the nation."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.format_string("n%s/c%s.java", "c_nationkey", "c_custkey").alias("path"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumns({"change_id": F.col("o_custkey").cast("string"), "id": F.col("o_orderkey").cast("string")})
    at = F.struct(_day("l_shipdate").alias("a"), (_day("l_shipdate") + F.col("l_linenumber") % 2).alias("b"))
    points = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set(at).alias("points"))
    none = F.lit(None).cast("int")
    units = o.join(points, "id", "left").select("change_id", "id", F.col("path").alias("file"), F.lit("").alias("old_path"), F.lit("modified").alias("status"), F.lit("").alias("symbol"), "points", none.alias("old_lo"), none.alias("old_hi"))
    start = _day("o_orderdate")
    base = o.select("change_id", "path", F.concat(F.lit("o"), "id").alias("name"), start.alias("start"), (start + 40 + F.col("o_orderkey") % 200).cast("int").alias("end"), F.col("o_orderkey").alias("ord"))

    def records(df, level, path, name, impact, rank, rollback):
        id_ = {"symbol": F.concat(F.lit("m/"), path, F.lit(":"), name), "file": F.concat(F.lit("m/"), path), "dir": F.concat(F.lit("m/"), path, F.lit("/"))}[level]
        return df.select(id_.alias("id"), F.lit(level).alias("level"), F.lit("m").alias("repo"), path.alias("path"), name.cast("string").alias("sym"), F.lit(None).cast("array<int>").alias("lines"), impact.cast("int").alias("impact"), rank.cast("double").alias("rank"), rollback.cast("int").alias("rollback"), none.alias("impact_cap"))

    nations = table(spark, sf, "nation").select("n_nationkey")
    book = records(o.filter("o_totalprice >= 150000"), "symbol", F.col("path"), F.concat(F.lit("o"), "id"), F.floor(F.col("o_totalprice") / 5000), F.lit(0), F.lit(0))
    book = book.unionByName(records(c.filter("c_acctbal > 0"), "file", F.col("path"), F.lit(None), F.floor(F.col("c_acctbal") / 100), F.lit(0), F.lit(0)))
    book = book.unionByName(records(nations, "dir", F.concat(F.lit("n"), "n_nationkey"), F.lit(None), F.lit(7), F.col("n_nationkey") * 10, F.col("n_nationkey")))
    found = unit_impacts(units, base, book, [], "m")
    return found.select("change_id", "id", "matched", "basis", F.size("also").alias("n_also"), "impact")
