"""Graphs: customers depend on parts and suppliers, parts on suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions.scalars import round_half_away
from changeloom.operators import graph
from changeloom.operators.labels import packed, reached_by
from changeloom.operators.members import resolved_aliases
from changeloom.operators.windows import percentile_below
from changeloom.queries import query, table


def _buys(spark, sf):
    """src: customer, dst: supplier, a row a line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def _nations(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("grp"))
    return c.unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("grp")))


def _chain(spark, sf):
    """Customers depend on the parts they buy, parts on those who supply them."""
    return _chain_numbers(spark, sf).distinct().select(_name("src").alias("src"), _name("dst").alias("dst"))


def _chain_numbers(spark, sf):
    """The chain's edges by numbers of nodes, with copies."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    first = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_number("c", "o_custkey").alias("src"), _number("p", "l_partkey").alias("dst"))
    return first.unionByName(lines.select(_number("p", "l_partkey").alias("src"), _number("s", "l_suppkey").alias("dst")))


def _number(letter, key):
    """A node's number, three to a key: a third of its name's size."""
    return F.col(key).cast("bigint") * 3 + "cps".index(letter)


def _name(number):
    kind = F.pmod(F.col(number), F.lit(3))
    return F.concat(F.substring(F.lit("cps"), kind.cast("int") + 1, F.lit(1)), F.expr(f"({number} - pmod({number}, 3)) div 3"))


def _ends(spark, sf):
    """All numbers that the chain may have."""
    of = lambda t, letter, key: table(spark, sf, t).select(_number(letter, key).alias("node")).distinct()
    return of("orders", "c", "o_custkey").unionByName(of("lineitem", "p", "l_partkey")).unionByName(of("lineitem", "s", "l_suppkey"))


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_GROUPS = """g AS (SELECT 'c' || c_custkey AS node, c_nationkey AS grp FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier)"""
_COLLAPSED = f"""{_EDGES}, {_GROUPS}, k AS (SELECT a.grp AS src, b.grp AS dst, 1 + ln(greatest(1e0, sum(1 + ln(greatest(1e0, n::DOUBLE))))) AS w
FROM e JOIN g a ON e.src = a.node JOIN g b ON e.dst = b.node WHERE a.grp <> b.grp GROUP BY 1, 2)"""
_CHAIN = """e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""
_ROUND = "floor({} * 1e{} + 0.5e0) / 1e{}"


@query(f"WITH {_EDGES} SELECT src, dst, n, {_ROUND.format('(1 + ln(greatest(1e0, n::DOUBLE)))', 6, 6)} AS w FROM e")
def edge_accumulate(spark, sf):
    edges = graph.weigh(graph.accumulate_edges(_buys(spark, sf)))
    return edges.select("src", "dst", "n", round_half_away(F.col("w"), 6).alias("w"))


@query(f"WITH {_COLLAPSED} SELECT src, dst, {_ROUND.format('w', 6, 6)} AS w FROM k")
def collapse_nation_graph(spark, sf):
    edges = graph.weigh(graph.accumulate_edges(_buys(spark, sf)))
    return graph.collapse(edges, _nations(spark, sf)).select("src", "dst", round_half_away(F.col("w"), 6).alias("w"))


def _rank_sql(before, nodes, edges, rounds):
    out = f"""WITH {before}, nodes AS ({nodes}), edges AS ({edges}), t AS (SELECT id, 1e0 / count(*) OVER () AS tele FROM nodes),
f AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges), r0 AS (SELECT id, tele AS pr FROM t)"""
    for i in range(1, rounds + 1):
        out += f""", m{i} AS (SELECT dst AS id, sum(pr * p) AS got FROM r{i - 1} JOIN f ON r{i - 1}.id = f.src GROUP BY 1),
l{i} AS (SELECT (SELECT sum(pr) FROM r{i - 1}) - coalesce((SELECT sum(got) FROM m{i}), 0) AS lost),
r{i} AS (SELECT t.id, 0.15e0 * tele + 0.85e0 * lost * tele + 0.85e0 * coalesce(got, 0e0) AS pr FROM t CROSS JOIN l{i} LEFT JOIN m{i} USING (id))"""
    return out + f" SELECT id, {_ROUND.format('pr', 9, 9)} AS pr FROM r{rounds}"


@query(_rank_sql(f"{_EDGES}, {_GROUPS}", "SELECT node AS id FROM g", "SELECT src, dst, 1 + ln(greatest(1e0, n::DOUBLE)) AS w FROM e", 3))
def pagerank_k3_supplier(spark, sf):
    edges = graph.weigh(graph.accumulate_edges(_buys(spark, sf)))
    ranks = graph.pagerank(_nations(spark, sf).select(F.col("node").alias("id")), edges, fixed=3)
    return ranks.select("id", round_half_away(F.col("pr"), 9).alias("pr"))


@query(_rank_sql(_COLLAPSED, "SELECT n_nationkey AS id FROM nation", "SELECT * FROM k", 5))
def pagerank_k5_collapsed(spark, sf):
    edges = graph.collapse(graph.weigh(graph.accumulate_edges(_buys(spark, sf))), _nations(spark, sf))
    ranks = graph.pagerank(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), edges, fixed=5)
    return ranks.select("id", round_half_away(F.col("pr"), 9).alias("pr"))


@query()
def pagerank_converged(spark, sf):
    """To a difference below 1e-10, over customers and suppliers. Edges are dealt by source, as all of the ranks' sums before the rounds need them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    refs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_number("c", "o_custkey").alias("src"), _number("s", "l_suppkey").alias("dst"))
    edges = graph.weigh(graph.accumulate_edges(refs.repartition("src")))
    ids = table(spark, sf, "customer").select(_number("c", "c_custkey").alias("id")).unionByName(table(spark, sf, "supplier").select(_number("s", "s_suppkey").alias("id")))
    return graph.pagerank(ids, edges.select("src", "dst", "w")).select(_name("id").alias("id"), "pr")


@query(f"""WITH {_CHAIN}, s AS (SELECT DISTINCT 's' || s_suppkey AS sid FROM supplier),
h1 AS (SELECT sid, src AS node FROM s JOIN e ON e.dst = sid), h2 AS (SELECT sid, e.src AS node FROM h1 JOIN e ON e.dst = h1.node),
u AS (SELECT * FROM h1 UNION SELECT * FROM h2)
SELECT sid, count(*) FILTER (node LIKE 'p%') AS parts, count(*) FILTER (node LIKE 'c%') AS customers FROM u GROUP BY sid""")
def reach_2hop_counts(spark, sf):
    starts = table(spark, sf, "supplier").select(_number("s", "s_suppkey").alias("sid")).withColumn("node", F.col("sid"))
    found = reached_by(packed(_chain_numbers(spark, sf)), starts, _ends(spark, sf).select("node", F.left(_name("node"), F.lit(1)).alias("letter")), 2)
    of = lambda letter: F.coalesce(F.sum(F.when((F.col("of") == "letter") & (F.col("value") == letter), F.col("n"))), F.lit(0))
    return found.groupBy("sid").agg(of("p").alias("parts"), of("c").alias("customers")).select(_name("sid").alias("sid"), "parts", "customers")


@query(f"""WITH {_CHAIN}, s AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey % 5 AS tag, 60 + s_nationkey AS score FROM supplier),
h1 AS (SELECT e.src AS node, tag, score FROM s JOIN e ON e.dst = s.node), h2 AS (SELECT e.src AS node, tag, score FROM h1 JOIN e ON e.dst = h1.node),
u AS (SELECT node, tag, score, 0 AS hop FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2),
m AS (SELECT node, tag, min(hop) AS hop FROM u GROUP BY 1, 2)
SELECT node, tag, floor(max(score) * (1 - 0.1e0 * hop) + 0.5e0)::INT AS score, hop::INT AS hop FROM u JOIN m USING (node, tag, hop) GROUP BY node, tag, hop""")
def hop_decay_tags(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), F.col("s_nationkey") % 5).alias("tag"), (F.col("s_nationkey") + 60).alias("score"))
    return graph.propagate(seeds, _chain(spark, sf), 2, 0.1)


@query(f"""WITH {_CHAIN}, t AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size < 10),
d AS (SELECT dst AS node, src AS caller FROM e WHERE src NOT IN (SELECT node FROM t)),
v AS (SELECT a.dst AS node, b.src AS caller FROM e a JOIN t ON a.src = t.node JOIN e b ON b.dst = a.src)
SELECT node, count(DISTINCT caller) AS callers FROM (SELECT * FROM d UNION SELECT * FROM v) GROUP BY node""")
def direct_callers_skip(spark, sf):
    """Small parts are seen through: who buys them calls their suppliers."""
    clear = table(spark, sf, "part").filter("p_size < 10").select(_number("p", "p_partkey").alias("node"))
    return graph.caller_counts(_chain_numbers(spark, sf), clear).select(_name("node").alias("node"), "callers")


@query("""SELECT c_custkey, 100e0 * (rank() OVER (ORDER BY c_acctbal) - 1) / count(*) OVER () AS percentile FROM customer""")
def percentile_below_global(spark, sf):
    return percentile_below(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "percentile")


@query("""SELECT c_custkey, 100e0 * (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1) / count(*) OVER (PARTITION BY c_nationkey) AS percentile FROM customer""")
def percentile_below_by_group(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return percentile_below(rows, "c_acctbal", by=["c_nationkey"]).select("c_custkey", "percentile")


_PLACED = "p_retailprice * (1e0 + (p_partkey % 7 - 3) * 0.4e-9)"


@query(f"""WITH v AS (SELECT p_partkey, {_PLACED} AS v FROM part), c AS (SELECT v, count(*) AS n FROM v GROUP BY v), s AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM c)
SELECT p_partkey, 100e0 * coalesce((SELECT max(upto) FROM s WHERE s.v < x.v * (1e0 - 1e-9)), 0) / (SELECT count(*) FROM v) AS percentile FROM v x""")
def percentile_at_tolerance(spark, sf):
    """Prices moved by up to 1.2e-9 of themselves: only some of what lies between counts as below."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_PLACED.replace("e0", "D").replace("0.4e-9", "0.4e-9D")).alias("v"))
    return percentile_below(rows, "v").select("p_partkey", "percentile")


@query(f"""WITH {_CHAIN}, d AS (SELECT DISTINCT dst AS node, src AS up FROM e), t AS (SELECT * FROM d UNION SELECT a.node, b.up FROM d a JOIN d b ON b.node = a.up)
SELECT node, count(*) AS syms, count(DISTINCT right(up, 2)) AS files, count(DISTINCT left(up, 1)) AS repos FROM t GROUP BY node""")
def dependents_of_all(spark, sf):
    """What depends on each node that anything depends on."""
    nodes = _ends(spark, sf).select("node", F.right(_name("node"), F.lit(2)).alias("file"), F.left(_name("node"), F.lit(1)).alias("repo"))
    return graph.dependent_counts(_chain_numbers(spark, sf), nodes).withColumn("node", _name("node"))


@query("""
WITH RECURSIVE a AS MATERIALIZED (SELECT p_partkey AS name, CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 1 WHEN p_partkey % 97 = 1 THEN p_partkey - 1 ELSE p_partkey + p_size END AS target FROM part WHERE p_size < 40 OR p_partkey % 97 < 2),
r AS (SELECT name, target, 1 AS steps FROM a UNION ALL SELECT r.name, a.target, steps + 1 FROM r JOIN a ON a.name = r.target WHERE steps < 8),
l AS (SELECT name, arg_max(target, steps) AS target, max(steps) AS steps FROM r GROUP BY name)
SELECT name, CASE WHEN target NOT IN (SELECT name FROM a) THEN target END AS means, CASE WHEN target NOT IN (SELECT name FROM a) THEN steps END::INTEGER AS steps FROM l""")
def alias_chains(spark, sf):
    """Small parts are aliases of later ones; some point at each other."""
    part = table(spark, sf, "part").select("p_partkey", "p_size").filter("p_size < 40 OR p_partkey % 97 < 2")
    first = F.expr("CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 1 WHEN p_partkey % 97 = 1 THEN p_partkey - 1 ELSE p_partkey + p_size END")
    both = part.select(F.col("p_partkey").alias("name"), F.explode(F.array(F.struct(first.alias("target"), F.lit(0).alias("ord")), F.struct(F.lit(-1).cast("bigint").alias("target"), F.lit(1).alias("ord")))).alias("x"))
    return resolved_aliases(both.select("name", "x.*"), [])


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT c, s FROM e WHERE s % 5 <> 0 UNION SELECT c, s + 1 FROM e WHERE s % 5 = 0 AND s + 1 IN (SELECT s_suppkey FROM supplier)),
r AS (SELECT 's' || s AS node, c_nationkey || '/' || c_mktsegment || ':' || c AS id, row_number() OVER (PARTITION BY s ORDER BY c_acctbal DESC, c_nationkey || '/' || c_mktsegment || ':' || c) AS place FROM m JOIN customer ON c = c_custkey)
SELECT node, string_agg(id, ' ' ORDER BY place) AS callers FROM r WHERE place <= 5 GROUP BY node""")
def callers_by_rank(spark, sf):
    """Customers as callers of suppliers, each fifth supplier internal and calling the next: the five of the highest balance."""
    from changeloom.plans.codemap import top_callers

    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier").select("s_suppkey")
    of = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nodes = customers.select(of("c", "c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("repo"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").cast("string").alias("sym"), F.lit(False).alias("internal"))
    nodes = nodes.unionByName(suppliers.select(of("s", "s_suppkey").alias("key"), F.lit("").alias("repo"), F.lit("").alias("file"), F.lit("").alias("sym"), (F.col("s_suppkey") % 5 == 0).alias("internal")))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    asked = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(of("c", "o_custkey").alias("src"), of("s", "l_suppkey").alias("dst")).distinct()
    passed = suppliers.filter("s_suppkey % 5 = 0").select(of("s", "s_suppkey").alias("src"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("dst")).join(suppliers.select(of("s", "s_suppkey").alias("dst")), "dst", "left_semi")
    found = top_callers(nodes, asked.unionByName(passed.select("src", "dst")), customers.select(of("c", "c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("pr")))
    return found.filter("substring(node, 2) % 5 <> 0").select("node", F.array_join("top_callers", " ").alias("callers"))
