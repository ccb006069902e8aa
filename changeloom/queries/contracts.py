"""Contracts and members: pages as operations, customers and suppliers as code that calls and serves them."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import contracts, graph, hierarchy, members, reports
from changeloom.queries import query, table
from changeloom.queries.graphs import _CHAIN, _chain, _chain_numbers, _name, _number
from changeloom.session import cut


@query("""WITH o AS (SELECT page_id, url FROM pages)
SELECT 'virtual:' || c.name AS src, 'op' || page_id AS dst FROM o JOIN (VALUES ('web', '^.*/en/[^/]*$'), ('mobile', '^.*/(?:de|fr)/.*$')) AS c(name, re) ON regexp_matches(url, c.re)""")
def virtual_consumers(spark, sf):
    ops = table(spark, sf, "pages").select(F.concat(F.lit("op"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("path"))
    _, edges = contracts.virtual_consumers(ops, [{"name": "web", "weight": 0.3, "specs": ["**/en/*"]}, {"name": "mobile", "weight": 0.1, "specs": ["**/{de,fr}/**"]}, {"name": "none", "weight": 0.1, "specs": []}])
    return edges.select("src", "dst")


_SINKS = f"""{_CHAIN}, k AS (SELECT 'c' || c_custkey AS key, 'func' AS kind, c_mktsegment AS category FROM customer UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size % 4 = 0 THEN 'type' ELSE 'func' END, p_brand FROM part),
y AS (SELECT k.key AS node, category, k.key AS callee FROM k WHERE kind <> 'type' UNION SELECT k.key, category, e.dst FROM k JOIN e ON e.src = k.key WHERE kind <> 'type'),
sinks AS (SELECT DISTINCT node, 'seven' AS tag, 70 AS score FROM y WHERE regexp_matches(callee, '^s[0-9]*7$') UNION SELECT DISTINCT node, 'auto', 30 FROM y WHERE regexp_matches(callee, '^p[0-9]*1$') AND category = 'AUTOMOBILE')"""


def _sinks(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.lit("func").alias("kind"), F.col("c_mktsegment").alias("category"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 4 == 0, "type").otherwise("func").alias("kind"), F.col("p_brand").alias("category"))
    return contracts.sink_hits(c.unionByName(p), _chain(spark, sf), [{"id": "seven", "score": 70, "callee": ["^s[0-9]*7$"]}, {"id": "auto", "score": 30, "callee": ["^p[0-9]*1$"], "category": ["AUTOMOBILE"]}])


@query(f"WITH {_SINKS} SELECT * FROM sinks")
def sink_hits(spark, sf):
    """Parts and customers that depend on suppliers ending in 7, and those of one segment on parts ending in 1."""
    return _sinks(spark, sf)


@query(f"""WITH {_SINKS}, h1 AS (SELECT DISTINCT s.node AS sid, e.dst AS node FROM sinks s JOIN e ON e.src = s.node WHERE s.score >= 40), h2 AS (SELECT sid, e.dst AS node FROM h1 JOIN e ON e.src = h1.node),
r AS (SELECT * FROM h1 UNION SELECT * FROM h2)
SELECT r.node, 'serves:' || tag AS tag, max(score) - 5 AS score FROM r JOIN sinks ON sinks.node = sid WHERE score >= 40 AND r.node <> sid GROUP BY ALL""")
def serve_tags(spark, sf):
    """Tagged nodes as operations: what they depend on implements them."""
    letter, key = F.left("node", F.lit(1)), F.expr("cast(substring(node, 2) AS bigint)")
    tags = cut(_sinks(spark, sf).select((key * 3 + F.instr(F.lit("cps"), letter) - 1).alias("node"), "tag", "score"))
    made = contracts.serve_tags(tags, tags.select("node"), _chain_numbers(spark, sf).withColumn("kind", F.lit("impl")))
    return made.withColumn("node", _name("node"))


_OPS = """o AS (SELECT 'op' || n_nationkey AS src, n_regionkey AS dir, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS op FROM nation),
m AS (SELECT 's' || s_suppkey AS key, n_regionkey AS dir, n_name, CASE s_suppkey % 3 WHEN 0 THEN 'Server.' || n_name WHEN 1 THEN '(*T).' || n_name ELSE 'x' END AS sym, CASE WHEN s_suppkey % 2 = 0 THEN 'method' ELSE 'func' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 2 = 0 OR s_suppkey % 3 = 1),
g AS (SELECT src, key FROM m JOIN o ON m.dir = o.dir AND lower(regexp_replace(regexp_extract(sym, '^Server\\.(.*)$', 1), '[^A-Za-z0-9]', '', 'g')) = op WHERE sym LIKE 'Server.%')"""


@query(f"""WITH {_OPS} SELECT src, key AS dst FROM g UNION
SELECT o.src, m.key FROM m JOIN o ON m.dir = o.dir AND lower(regexp_replace(regexp_extract(sym, '\\)\\.(.*)$', 1), '[^A-Za-z0-9]', '', 'g')) = op WHERE kind = 'method' AND sym LIKE '%).%' AND o.src NOT IN (SELECT src FROM g)""")
def server_fallback(spark, sf):
    """Suppliers as methods that serve their nation: by a generated interface, else by name."""
    n, i = table(spark, sf, "nation"), F.col("s_suppkey")
    ops = n.select(F.lit("shop").alias("repo"), F.col("n_regionkey").cast("string").alias("dir"), F.concat(F.lit("op"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).filter((F.col("s_nationkey") % 2 == 0) | (i % 3 == 1))
    sym = F.when(i % 3 == 0, F.concat(F.lit("Server."), "n_name")).when(i % 3 == 1, F.concat(F.lit("(*T)."), "n_name")).otherwise("x")
    nodes = s.select(F.concat(F.lit("s"), i.cast("string")).alias("key"), F.lit("shop").alias("repo"), F.col("n_regionkey").cast("string").alias("dir"), sym.alias("sym"), F.when(i % 2 == 0, "method").otherwise("func").alias("kind"))
    return contracts.server_edges(nodes, ops, r"^Server\.(.*)$").select("src", "dst")


@query("""WITH c AS (SELECT 'Brand#11' AS client_dir, 'a' AS spec UNION ALL SELECT 'Brand#2', 'b' UNION ALL SELECT 'Brand#12/STANDARD', 'a'), p AS (SELECT 'p' || p_partkey AS key, p_brand || '/' || replace(p_type, ' ', '/') AS dir, 'get' || p_size AS op FROM part),
o AS (SELECT DISTINCT 'a' AS spec, 'op' || p_size AS dst, 'get' || p_size AS op FROM part WHERE p_size < 10)
SELECT DISTINCT key AS src, dst FROM p JOIN c ON dir = client_dir OR starts_with(dir, client_dir || '/') JOIN o USING (spec, op)""")
def configured_clients(spark, sf):
    part = table(spark, sf, "part")
    nodes = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("shop").alias("repo"), F.concat_ws("/", "p_brand", F.regexp_replace("p_type", " ", "/")).alias("dir"), F.concat(F.lit("get-"), F.col("p_size").cast("string")).alias("sym"))
    size = F.col("p_size").cast("string")
    ops = part.filter("p_size < 10").select(F.lit("a").alias("spec"), F.concat(F.lit("op"), size).alias("key"), F.concat(F.lit("Get"), size).alias("name")).distinct()
    clients = spark.createDataFrame([("shop", "Brand#11", "a"), ("shop", "Brand#2", "b"), ("shop", "Brand#12/STANDARD", "a")], "repo string, client_dir string, spec string")
    return contracts.configured_clients(nodes, ops, clients).select("src", "dst")


@query(f"""WITH {_SINKS}, n AS (SELECT 'p' || p_partkey AS key, p_brand AS file FROM part WHERE p_size % 10 <> 0) SELECT file, tag, max(score) AS score, max(score / 10)::INT AS floor FROM sinks JOIN n ON node = key GROUP BY ALL""")
def file_tags(spark, sf):
    """Brands as files of the parts; parts of some sizes are internal."""
    tags = _sinks(spark, sf).select(F.col("node").alias("key"), "tag", "score", (F.col("score") / 10).cast("int").alias("floor"))
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("shop").alias("repo"), F.col("p_brand").alias("file"), (F.col("p_size") % 10 == 0).alias("internal"))
    return hierarchy.file_tags(tags, nodes).select("file", "tag", "score", "floor")


@query(f"""WITH {_SINKS}, b AS (SELECT node, tag, max(score) AS score FROM (SELECT * FROM sinks UNION ALL SELECT node, 'low', 10 FROM sinks) GROUP BY ALL)
SELECT node, string_agg(tag || '=' || score, ',' ORDER BY score DESC, tag) AS tags FROM b GROUP BY node""")
def tags_by_score(spark, sf):
    s = _sinks(spark, sf)
    both = s.unionByName(s.select("node", F.lit("low").alias("tag"), F.lit(10).alias("score")))
    made = hierarchy.sorted_tags(both, ["node"])
    return made.select("node", F.concat_ws(",", F.transform("tags", lambda t: F.concat_ws("=", t["tag"], t["score"].cast("string")))).alias("tags"))


@query("""SELECT p_partkey FROM part WHERE p_size % 6 >= 4 OR p_size * 2 >= 80 OR p_size % 7 = 0 OR p_size = 11 OR p_size % 13 = 5""")
def emitted_symbols(spark, sf):
    size = F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", F.when(size % 7 == 0, "api-op").otherwise("func").alias("kind"), (size % 13 == 5).alias("exported"), (size % 6).alias("caller_files"), (size * 2).alias("top_score"), (size == 11).alias("virtual_caller"))
    return hierarchy.emitted(rows, 4, 80, True).select("p_partkey")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 3 AS up FROM part WHERE p_partkey <> p_partkey // 3), m AS (SELECT p_partkey AS k, name FROM part, unnest(['a', 'b', 'c']) AS u(name) WHERE (p_partkey + ascii(name)) % 4 <> 0),
line AS (SELECT k, up AS at, 0 AS hop FROM t UNION ALL SELECT line.k, t.up, hop + 1 FROM line JOIN t ON t.k = line.at WHERE t.up <> t.k)
SELECT arg_min('m' || m.k || u.name, line.hop) AS src, 'm' || line.k || u.name AS dst FROM line JOIN m AS u ON u.k = line.k JOIN m ON m.k = line.at AND m.name = u.name GROUP BY line.k, u.name""")
def override_edges(spark, sf):
    """Parts as types: a type's super is the part of a third of its number; each has some of three members."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey")
    some = part.select(k.cast("string").alias("type"), F.explode(F.array(*map(F.lit, "abc"))).alias("name"), "p_partkey").filter((k + F.ascii("name")) % 4 != 0)
    supers = part.select(k.cast("string").alias("type"), F.floor(k / 3).cast("string").alias("super")).filter("type <> super")
    return members.override_edges(some.select("type", "name", F.concat(F.lit("m"), "type", "name").alias("key")), supers).select("src", "dst")


@query("""WITH r AS (SELECT DISTINCT n_regionkey AS iface, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000), h AS (SELECT DISTINCT c_nationkey AS type, c_mktsegment AS name FROM customer WHERE c_acctbal > 0)
SELECT iface, type FROM r JOIN h USING (name) GROUP BY iface, type HAVING count(*) = (SELECT count(*) FROM r AS q WHERE q.iface = r.iface)""")
def method_sets(spark, sf):
    """Nations that have customers with money in all segments in which a region has rich ones."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sig = F.lit("()").alias("sig")
    need = c.filter("c_acctbal > 9000").select(F.col("n_regionkey").alias("iface"), F.col("c_mktsegment").alias("name"), sig)
    return members.method_sets(need, c.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("type"), F.col("c_mktsegment").alias("name"), sig))


@query(f"""WITH {_CHAIN}, n AS (SELECT 'p' || p_partkey AS key, CASE WHEN p_size < 5 THEN '' ELSE p_brand END AS file FROM part)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE file = '') AS stubs, (SELECT count(*) FROM e WHERE dst IN (SELECT key FROM n)) AS edges, (SELECT count(*) FROM e WHERE dst NOT IN (SELECT key FROM n)) AS external,
 (SELECT count(*) FROM pages WHERE url LIKE '%/en/%') AS matched, (SELECT count(*) FROM pages WHERE url NOT LIKE '%/en/%') AS unmatched""")
def graph_statistics(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") < 5, "").otherwise(F.col("p_brand")).alias("file"))
    urls = table(spark, sf, "pages").select(F.col("url").contains("/en/").alias("matched"))
    return reports.graph_statistics(nodes, _chain(spark, sf), nodes, urls)


@query(f"""WITH {_CHAIN}, n AS (SELECT 'c' || c_custkey AS key FROM customer UNION ALL SELECT 'p' || p_partkey FROM part)
SELECT src, dst, dst IN (SELECT key FROM n) AS inside FROM e WHERE src IN (SELECT key FROM n)""")
def resolved_edges(spark, sf):
    key = lambda t, c, k: table(spark, sf, t).select(F.concat(F.lit(k), F.col(c).cast("string")).alias("key"))
    inside, outside = graph.resolve_edges(_chain(spark, sf), key("customer", "c_custkey", "c").unionByName(key("part", "p_partkey", "p")))
    return inside.select("src", "dst", F.lit(True).alias("inside")).unionByName(outside.select("src", "dst", F.lit(False).alias("inside")))


@query(f"""WITH {_CHAIN}, s AS (SELECT 's' || s_suppkey AS sid FROM supplier WHERE s_suppkey % 5 = 0), h1 AS (SELECT sid, src AS node FROM s JOIN e ON e.dst = sid), h2 AS (SELECT sid, e.src AS node FROM h1 JOIN e ON e.dst = h1.node), u AS (SELECT * FROM h1 UNION SELECT * FROM h2),
n AS (SELECT 'p' || p_partkey AS node, p_brand AS file, 'parts' AS repo FROM part WHERE p_size > 3 UNION ALL SELECT 'c' || c_custkey, c_mktsegment, 'customers' FROM customer)
SELECT sid, count(DISTINCT node) AS syms, count(DISTINCT file) AS files, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM u JOIN n USING (node) GROUP BY sid""")
def dependents(spark, sf):
    """What depends on every fifth supplier; small parts are internal."""
    p = table(spark, sf, "part").select(_number("p", "p_partkey").alias("node"), F.col("p_brand").alias("file"), F.lit("parts").alias("repo"), (F.col("p_size") <= 3).alias("internal"))
    c = table(spark, sf, "customer").select(_number("c", "c_custkey").alias("node"), F.col("c_mktsegment").alias("file"), F.lit("customers").alias("repo"), F.lit(False).alias("internal"))
    starts = table(spark, sf, "supplier").filter("s_suppkey % 5 = 0").select(_number("s", "s_suppkey").alias("sid")).withColumn("node", F.col("sid"))
    made = graph.dependents(starts, _chain_numbers(spark, sf), p.unionByName(c), 2)
    return made.select(_name("sid").alias("sid"), "syms", "files", F.concat_ws(",", "repos").alias("repos"))
