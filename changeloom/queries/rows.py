"""Windows, rankings, intervals, islands, diffs over events, conversations, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions.scalars import greedy_fill, pack
from changeloom.operators import joins, windows
from changeloom.queries import query, table
from changeloom.sources.diffs import parse_diff


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf):
    return windows.latest_per_key(_events(spark, sf), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_per_key(spark, sf):
    return windows.first_per_key(_events(spark, sf), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY floor(s_acctbal / 1000) DESC, s_nationkey, s_suppkey LIMIT 25""")
def topk_composite_key(spark, sf):
    """A top-k report by a composite key."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return windows.top(rows, [F.floor(F.col("s_acctbal") / 1000).desc(), F.asc("s_nationkey"), F.asc("s_suppkey")], 25)


@query("""SELECT p_brand, p_partkey, p_retailprice, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) WHERE rk <= 5""")
def topk_per_group(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.topk_per_group(rows, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5)


@query("""
WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
y AS (SELECT *, 1 + sum(CASE WHEN b IS NOT NULL AND b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x)
SELECT user_id, island::INT AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM y GROUP BY user_id, island""")
def islands_by_value(spark, sf):
    runs = windows.islands(_events(spark, sf), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return runs.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_OP = "CASE WHEN role = 'assistant' THEN '+' WHEN turn % 3 = 0 THEN '-' ELSE ' ' END"


@query(f"""
WITH x AS (SELECT conv_id, turn, {_OP} AS op FROM conversations)
SELECT conv_id, turn, op, 1 + coalesce(sum((op <> '+')::INT) OVER w, 0)::BIGINT AS old_no, 1 + coalesce(sum((op <> '-')::INT) OVER w, 0)::BIGINT AS new_no,
       op = '+' AND coalesce(last_value(nullif(op, '+') IGNORE NULLS) OVER w = ' ', TRUE) AS inserts
FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_line_numbers(spark, sf):
    """Turns as the lines of a change: their numbers before and after, and where lines are only put in."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_OP} AS op")
    by, order = ["conv_id"], [F.col("turn")]
    numbered = windows.running_numbers(turns, by, order, {"old_no": (F.lit(1), (F.col("op") != "+").cast("int")), "new_no": (F.lit(1), (F.col("op") != "-").cast("int"))})
    return windows.insert_points(numbered, by, order, "op")


@query(f"""
WITH x AS (SELECT conv_id, turn, {_OP} AS op, length(replace(text, chr(10), ' ')) AS n FROM conversations)
SELECT 'c' || conv_id AS change_id, 'conv/' || conv_id || '.txt' AS path, row_number() OVER o AS line_ord, op, n AS n_chars,
       1 + coalesce(sum((op <> '+')::INT) OVER w, 0)::BIGINT AS old_no, 1 + coalesce(sum((op <> '-')::INT) OVER w, 0)::BIGINT AS new_no
FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY conv_id ORDER BY turn)""")
def diff_parse_lines(spark, sf):
    """Each conversation written as a unified diff of its turns, and read back as numbered lines."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_OP} || replace(text, chr(10), ' ') AS line")
    body = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    path = F.concat(F.lit("conv/"), "conv_id", F.lit(".txt"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,1 @@\n"))
    diffs = body.select(F.concat(F.lit("c"), "conv_id").alias("change_id"), F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    files, lines = parse_diff(diffs)
    met = lines.join(files.select("change_id", "file_ord", "path"), ["change_id", "file_ord"])
    return met.select("change_id", "path", F.col("line_ord").cast("bigint"), "op", F.char_length("text").cast("bigint").alias("n_chars"), F.col("old_no").cast("bigint"), F.col("new_no").cast("bigint"))


@query("""
SELECT user_id, event_id, coalesce(lead(s) OVER w - 1, s + 3600) AS span_end FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""")
def next_start_span(spark, sf):
    rows = _events(spark, sf).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return rows.select("user_id", "event_id", windows.span_end(["user_id"], [F.col("s"), F.col("event_id")], "s", F.col("s") + 3600).alias("span_end"))


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber * 10 - lag(l_linenumber * 10 + l_quantity % 9) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS gap FROM lineitem""")
def gap_before(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"s": F.col("l_linenumber") * 10, "e": F.col("l_linenumber") * 10 + F.col("l_quantity") % 9})
    return rows.select("l_orderkey", "l_linenumber", windows.gap_before(["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "s", "e").alias("gap"))




@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber AS lo, l_linenumber + CAST(floor(l_quantity) AS BIGINT) % 3 AS hi FROM lineitem)
SELECT a.l_orderkey, count(*) AS pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::BIGINT AS shared
FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.l_linenumber < b.l_linenumber GROUP BY 1""")
def interval_overlap_join(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("bigint").alias("lo"), (F.col("l_linenumber") + F.floor("l_quantity") % 3).alias("hi"))
    b = r.toDF("l_orderkey", "other", "lo2", "hi2")
    both = joins.overlap_join(r, b, ["l_orderkey"], ("lo", "hi"), ("lo2", "hi2")).filter("l_linenumber < other")
    return both.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum(F.least("hi", "hi2") - F.greatest("lo", "lo2") + 1).alias("shared"))


@query("""
WITH r AS (SELECT l_orderkey, l_partkey AS ord, l_partkey AS name, l_linenumber - CAST(floor(l_quantity) AS BIGINT) % 4 AS s, l_linenumber + CAST(floor(l_quantity) AS BIGINT) % 4 AS e FROM lineitem),
p AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem)
SELECT p.l_orderkey, line, arg_min(name, struct_pack(w := e - s, o := ord)) AS name FROM p LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND line BETWEEN s AND e GROUP BY 1, 2""")
def innermost_interval(spark, sf):
    lines = table(spark, sf, "lineitem")
    w = F.floor("l_quantity") % 4
    ranges = lines.select("l_orderkey", F.col("l_partkey").alias("ord"), F.col("l_partkey").alias("name"), (F.col("l_linenumber") - w).alias("s"), (F.col("l_linenumber") + w).alias("e"))
    points = lines.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"))
    return joins.innermost(points, ranges, ["l_orderkey"], "line", "s", "e", "name", "ord")


@query("""
WITH s AS (SELECT n_nationkey, c_custkey, floor(c_acctbal / 2000)::INT AS score FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 2000)
SELECT n_nationkey, c_custkey, score FROM s QUALIFY rank() OVER (PARTITION BY n_nationkey ORDER BY score DESC) = 1""")
def best_match_ties(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey")
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return joins.best_match(nations, customers, ["n_nationkey"], F.floor(F.col("c_acctbal") / 2000).cast("int"), ["n_nationkey"]).select("n_nationkey", "c_custkey", "score")


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey, c_acctbal FROM customer),
n AS (SELECT c_nationkey, max(c_acctbal) AS v FROM c GROUP BY 1 HAVING max(c_acctbal) > 9500),
r AS (SELECT n_regionkey, max(c_acctbal) AS v FROM c JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT k AS qid, CASE WHEN c.c_acctbal > 5000 THEN 'file' WHEN n.v IS NOT NULL THEN 'dir' ELSE 'repo' END AS matched,
       CASE WHEN c.c_acctbal > 5000 THEN c.c_acctbal WHEN n.v IS NOT NULL THEN n.v ELSE r.v END AS value
FROM c JOIN nation ON n_nationkey = c.c_nationkey LEFT JOIN n ON n.c_nationkey = c.c_nationkey LEFT JOIN r USING (n_regionkey)""")
def fallback_lookup_levels(spark, sf):
    """A customer's own balance if it is high, else its nation's highest if that is, else its region's."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), "c_nationkey", "c_acctbal").join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    nation = c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("value")).filter("value > 9500")
    region = c.groupBy("n_regionkey").agg(F.max("c_acctbal").alias("value"))
    one = F.lit(1).alias("depth")
    levels = [
        ("file", c.filter("c_acctbal > 5000").select("qid", one, F.col("c_acctbal").alias("value"))),
        ("dir", c.join(nation, "c_nationkey").select("qid", one, "value")),
        ("repo", c.join(region, "n_regionkey").select("qid", one, "value")),
    ]
    return joins.fallback(c.select("qid"), "qid", levels).select("qid", "matched", "value")


_TURNS = "SELECT conv_id, list({'n': length(text), 'used': 0::BIGINT, 'k': 0, 'out': ''} ORDER BY turn) AS l, {'n': 0::BIGINT, 'used': 0::BIGINT, 'k': 0, 'out': ''} AS nil, string_agg(turn, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


def _turns(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))).alias("t"))
    return t.withColumn("sizes", F.transform("t", lambda x: x["n"]))


@query(f"""WITH t AS ({_TURNS}) SELECT conv_id, turns,
list_reduce(l, lambda a, x: {{'n': x.n, 'used': a.used + CASE WHEN a.used + x.n <= 400 THEN x.n ELSE 0 END, 'k': 0, 'out': a.out || CASE WHEN a.used + x.n <= 400 THEN 'y' ELSE 'n' END}}, nil).out AS taken FROM t""")
def greedy_budget_fill(spark, sf):
    """Turns of a conversation that fit into 400 characters, taken in order; one too long is skipped."""
    taken = F.array_join(F.transform(greedy_fill(F.col("sizes"), 400), lambda x: F.when(x, "y").otherwise("n")), "")
    return _turns(spark, sf).select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"].cast("string")), ",").alias("turns"), taken.alias("taken"))


@query(f"""WITH t AS ({_TURNS}) SELECT conv_id,
substr(list_reduce(l, lambda a, x: {{'n': x.n, 'used': CASE WHEN a.used > 0 AND a.used + x.n > 400 THEN 0 ELSE a.used END + x.n, 'k': a.k + CASE WHEN a.used > 0 AND a.used + x.n > 400 THEN 1 ELSE 0 END, 'out': a.out || ',' || (a.k + CASE WHEN a.used > 0 AND a.used + x.n > 400 THEN 1 ELSE 0 END)}}, nil).out, 2) AS batch FROM t""")
def batch_packing(spark, sf):
    return _turns(spark, sf).select("conv_id", F.array_join(pack(F.col("sizes"), 400).cast("array<string>"), ",").alias("batch"))
