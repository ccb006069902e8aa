"""History, recency and co-change over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions.scalars import age_days, half_life, level, points, round_half_away, whole
from changeloom.operators.hierarchy import nearest_rank
from changeloom.operators.history import add_unknown, cochange, file_partners, merge_history
from changeloom.operators.joins import missing
from changeloom.queries import query, table

_AGE = "(epoch_us(ref) - epoch_us({0}))::DOUBLE / 86400e6"


def _latest(df, column):
    """The largest value as a table of one row, which is broadcast."""
    return F.broadcast(df.agg(F.max(column).alias("ref")))


@query(f"""
WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderdate) OVER () AS ref FROM orders),
c AS (SELECT o_custkey, floor(sum(pow(0.5e0, greatest(0e0, {_AGE.format("o_orderdate")}) / 180e0)) * 1e6 + 0.5e0) / 1e6 AS activity, count(*) AS n FROM o GROUP BY 1),
p AS (SELECT n_regionkey, n_nationkey, activity, n, least(100e0, greatest(0e0, activity - 0.5e0) * 20e0) AS score FROM c JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT n_regionkey, n_nationkey, count(*) AS customers, sum(n)::BIGINT AS orders, quantile_disc(activity, 0.75) AS p75_activity, floor(quantile_disc(score, 0.75) + 0.5e0)::INT AS score FROM p GROUP BY 1, 2)
SELECT r_name AS region, n_name AS nation, customers, orders, p75_activity, score,
       CASE WHEN score >= 75 THEN 'critical' WHEN score >= 55 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level
FROM g JOIN nation USING (n_nationkey) JOIN region ON r_regionkey = g.n_regionkey""")
def halflife_activity_customer(spark, sf):
    """Recency-weighted activity of customers, its 75th percentile by nation, as points and a band."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    decay = half_life(age_days(F.col("o_orderdate"), F.col("ref")), 180)
    per = orders.crossJoin(_latest(orders, "o_orderdate")).groupBy("o_custkey").agg(round_half_away(F.sum(decay), 6).alias("activity"), F.count("*").alias("n"))
    met = per.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    scored = met.withColumn("score", points(F.col("activity"), 20, 0.5, 100))
    by_nation = scored.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), nearest_rank("activity", 0.75).alias("p75_activity"), whole(nearest_rank("score", 0.75)).alias("score"))
    named = by_nation.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "customers", "orders", "p75_activity", "score", level(F.col("score")).alias("level"))


@query(f"""
WITH e AS (SELECT *, max(ts) OVER () AS ref FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors
FROM e WHERE {_AGE.format("ts")} <= 14 AND {_AGE.format("ts")} >= -1 / 1440.0 GROUP BY user_id""")
def windowed_counts_user(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_type")
    age = age_days(F.col("ts"), F.col("ref"))
    seen = events.crossJoin(_latest(events, "ts")).filter((age <= 14) & (age >= -1 / 1440))
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""
SELECT l_partkey, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def distinct_actors_per_part(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    met = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("lines"))


@query("""
WITH s AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT l_partkey, count(DISTINCT l_orderkey) AS all_orders, count(DISTINCT CASE WHEN parts <= 5 THEN l_orderkey END) AS small_orders
FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_partkey""")
def bulk_order_flag(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    size = lines.groupBy("l_orderkey").agg(F.count("*").alias("parts"))
    return lines.join(size, "l_orderkey").groupBy("l_partkey").agg(F.count("*").alias("all_orders"), F.count_if(F.col("parts") <= 5).alias("small_orders"))


@query("""
WITH r AS (SELECT max(ts) AS ref FROM events)
SELECT user_id, floor((epoch_us(ref) - epoch_us(max(ts)))::DOUBLE / 86400e6)::INT AS age_days, count(*) AS n FROM events, r GROUP BY user_id, ref""")
def last_seen_age_days(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return last.crossJoin(_latest(events, "ts")).select("user_id", F.floor(age_days(F.col("last"), F.col("ref"))).cast("int").alias("age_days"), "n")


@query("""
WITH g AS (SELECT user_id, max(struct_pack(ts := ts, id := event_id)) FILTER (event_type = 'error') AS gone FROM events GROUP BY 1)
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events JOIN g USING (user_id)
WHERE gone IS NULL OR struct_pack(ts := ts, id := event_id) > gone GROUP BY user_id""")
def reset_after_marker(spark, sf):
    """Only what follows a user's last error counts."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    at = F.struct("ts", "event_id")
    gone = events.filter("event_type = 'error'").groupBy("user_id").agg(F.max(at).alias("gone"))
    live = events.join(gone, "user_id", "left").filter(F.col("gone").isNull() | (at > F.col("gone")))
    return live.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


def _pairs_sql(group, item, source, n, conf, k, where="TRUE"):
    return f"""
WITH x AS (SELECT DISTINCT {group} AS g, {item} AS item FROM {source}),
s AS (SELECT g FROM x GROUP BY g HAVING count(*) <= 40), y AS (SELECT x.* FROM x JOIN s USING (g)),
c AS (SELECT item, count(*) AS a FROM y GROUP BY 1),
p AS (SELECT a.item, b.item AS partner, count(*) AS n FROM y a JOIN y b ON a.g = b.g AND a.item <> b.item GROUP BY 1, 2),
f AS (SELECT p.*, p.n::DOUBLE / c.a AS cf FROM p JOIN c USING (item) WHERE p.n >= {n} AND p.n::DOUBLE / c.a >= {conf}),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) AS rk0 FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) AS rk FROM r WHERE {where})
SELECT item, partner, n, floor(cf * 100 + 0.5e0) / 100 AS conf, rk::INT AS rk FROM q WHERE rk <= {k}"""


@query(_pairs_sql("l_orderkey", "l_partkey", "lineitem", 1, "0e0", 5))
def cochange_parts_topk(spark, sf):
    return cochange(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 1, 0.0, 5)


@query(_pairs_sql("l_orderkey", "l_suppkey", "lineitem", 3, "0.02e0", 5))
def cochange_min_support(spark, sf):
    return cochange(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 3, 0.02, 5)


@query("""
WITH x AS (SELECT DISTINCT o_orderpriority AS repo, o_orderkey AS g, CASE l_suppkey % 7 WHEN 0 THEN 'mocks/' ELSE '' END || 's' || l_suppkey || '.go' AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A'),
c AS (SELECT repo, item, count(*) AS a FROM x GROUP BY ALL),
p AS (SELECT a.repo, a.item, b.item AS partner, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.item <> b.item GROUP BY ALL),
f AS (SELECT p.*, p.n::DOUBLE / c.a AS cf FROM p JOIN c USING (repo, item) WHERE p.n >= 2 AND p.n::DOUBLE / c.a >= 0.02e0),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, item ORDER BY n DESC, partner) AS rk0 FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY repo, item ORDER BY n DESC, partner) AS rk FROM r WHERE rk0 <= 10 AND partner NOT LIKE 'mocks/%'
  AND NOT (repo = '1-URGENT' AND partner IN (SELECT 's' || s_suppkey || '.go' FROM supplier WHERE s_suppkey % 3 = 0)))
SELECT repo, item, partner, n, floor(cf * 100 + 0.5e0) / 100 AS conf, rk::INT AS rk FROM q WHERE rk <= 5""")
def partners_by_repository(spark, sf):
    """Suppliers as files that change in orders: partners within a priority, without mocks and what is generated in one priority."""
    name = F.concat(F.when(F.col("l_suppkey") % 7 == 0, "mocks/").otherwise(""), F.lit("s"), "l_suppkey", F.lit(".go"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("repo"))
    status = F.when(F.col("l_returnflag") == "A", "D").otherwise("M")
    rows = table(spark, sf, "lineitem").join(orders, "l_orderkey").select("repo", F.col("l_orderkey").alias("hash"), status.alias("status"), name.alias("path"))
    made = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.lit("1-URGENT").alias("repo"), F.concat(F.lit("s"), "s_suppkey", F.lit(".go")).alias("path"))
    return file_partners(rows, made, min_n=2, min_conf=0.02)


@query(_pairs_sql("l_orderkey", "l_partkey", "lineitem", 1, "0e0", 5, "rk0 <= 10 AND partner IN (SELECT p_partkey FROM part WHERE p_size >= 25)"))
def alive_partner_semi(spark, sf):
    """The ten strongest partners are ranked, those of parts that are alive stay, five at most."""
    ranked = cochange(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 1, 0.0, 10)
    alive = table(spark, sf, "part").filter("p_size >= 25").select(F.col("p_partkey").alias("partner"))
    from changeloom.operators.windows import topk_per_group

    kept = ranked.join(alive, "partner", "left_semi").drop("rk")
    return topk_per_group(kept, ["item"], [F.desc("n"), F.asc("partner")], 5).select("item", "partner", "n", "conf", "rk")


@query(f"""
WITH best AS (SELECT item, partner FROM ({_pairs_sql("l_orderkey", "l_suppkey", "lineitem", 1, "0e0", 1)})),
x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
w AS (SELECT DISTINCT l_orderkey, partner FROM x JOIN best ON l_suppkey = item)
SELECT w.l_orderkey, count(*) AS missing FROM w LEFT JOIN x ON x.l_orderkey = w.l_orderkey AND x.l_suppkey = w.partner WHERE x.l_suppkey IS NULL GROUP BY 1""")
def missing_partner_anti(spark, sf):
    """How many of the strongest partners of an order's suppliers the order lacks."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    best = cochange(lines, "l_orderkey", "l_suppkey", 1, 0.0, 1).select(F.col("item").alias("l_suppkey"), "partner")
    lists = lines.join(best, "l_suppkey", "left").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("present"), F.collect_set("partner").alias("partners"))
    return missing(lists, "partners", "present").filter(F.size("missing") > 0).select("l_orderkey", F.size("missing").cast("bigint").alias("missing"))


@query("""
WITH ref AS (SELECT max(ts) AS r FROM events), cut AS (SELECT r - INTERVAL 5 DAY AS since FROM ref),
fresh AS (SELECT event_id, user_id, ts FROM events, cut WHERE ts >= since),
old AS (SELECT event_id, user_id, ts FROM events, ref WHERE ts >= r - INTERVAL 20 DAY),
u AS (SELECT * FROM fresh UNION ALL SELECT o.* FROM old o ANTI JOIN fresh f ON o.event_id = f.event_id)
SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM u GROUP BY user_id""")
def union_window_truncate(spark, sf):
    """Fresh events and the old ones still in the window that aren't among them."""
    events = table(spark, sf, "events").select(F.lit("r").alias("repo"), F.col("event_id").alias("hash"), "user_id", "ts")
    ref = F.broadcast(events.agg(F.max("ts").alias("_ref")))
    dated = events.crossJoin(ref)
    fresh = dated.filter("ts >= _ref - INTERVAL 5 DAYS")
    both = merge_history(fresh, dated, F.col("_ref") - F.expr("INTERVAL 20 DAYS"))
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.max("hash").alias("last_event"))


@query("""
SELECT c_custkey AS key, (o.k IS NOT NULL) AS ordered FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey
UNION ALL SELECT DISTINCT o_custkey, TRUE FROM orders ANTI JOIN customer ON o_custkey = c_custkey""")
def anti_known(spark, sf):
    """Customers that ordered, and those known that didn't, added."""
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("ordered", F.lit(True))
    rest = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit(False).alias("ordered"))
    return add_unknown(rest, known, ["key"])
