"""Paths: names, globs, ancestors, roll-ups and inheritance over the URLs of pages, and trees of parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import patterns
from changeloom.functions.scalars import ancestors, basename, dirname, extension, normal_operation, normal_symbol, url_host, url_path
from changeloom.operators import hierarchy, joins
from changeloom.queries import query, table

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
#: host/path without slashes at its ends
_FULL = f"regexp_replace({_HOST} || {_PATH}, '/+$', '')"
_UP = "[array_to_string(p[1:i], '/') FOR i IN range(1, len(p))]"


def _pages(spark, sf):
    full = F.regexp_replace(F.concat(url_host(F.col("url")), url_path(F.col("url"))), "/+$", "")
    return table(spark, sf, "pages").select("page_id", "url", full.alias("path"), F.char_length("html").cast("bigint").alias("n"))


@query(f"""SELECT page_id, {_HOST} AS host, {_PATH} AS path, regexp_extract({_PATH}, '[^/]*$') AS base, regexp_replace(regexp_replace({_PATH}, '[^/]*$', ''), '/$', '') AS dir,
regexp_extract(regexp_extract({_PATH}, '[^/]*$'), '(\\.[^.]*)$', 1) AS ext FROM pages""")
def path_parts(spark, sf):
    path = url_path(F.col("url"))
    return table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"), path.alias("path"), basename(path).alias("base"), dirname(path).alias("dir"), extension(path).alias("ext"))


@query("""SELECT p_partkey, regexp_replace('(*' || replace(p_brand, '#', '') || ').' || p_name, '^\\(\\*?([^)]*)\\)\\.', '\\1.') AS symbol, lower(regexp_replace(p_type, '[^\\p{L}\\p{Nd}]', '', 'g')) AS operation FROM part""")
def norm_symbol_and_operation(spark, sf):
    symbol = F.concat(F.lit("(*"), F.regexp_replace("p_brand", "#", ""), F.lit(")."), "p_name")
    return table(spark, sf, "part").select("p_partkey", normal_symbol(symbol).alias("symbol"), normal_operation(F.col("p_type")).alias("operation"))


@query(f"""WITH x AS (SELECT page_id, {_FULL} AS path FROM pages)
SELECT page_id, regexp_matches(path, '^(?:.*/)?en/[^/]*$') AS english, regexp_matches(path, '^[^/]*(?:\\.org|\\.net)/.*$') AS not_com, regexp_matches(path, '^.*/[^/][^/]$') AS two FROM x""")
def glob_filters_map(spark, sf):
    match = lambda g: F.col("path").rlike(patterns.map_glob(g))
    return _pages(spark, sf).select("page_id", match("**/en/*").alias("english"), match("*{.org,.net}/**").alias("not_com"), match("**/??").alias("two"))


@query(f"""WITH x AS (SELECT page_id, {_FULL} AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '[^/]*\\.html$') THEN '*.html' WHEN path LIKE '%/fr/%' THEN 'fr/' WHEN regexp_matches(path, '^(.*/)?de/[^/]*$') THEN '**/de/*' END AS pattern FROM x""")
def glob_filters_policy(spark, sf):
    """The first pattern that matches."""
    tests = [(p, patterns.policy_glob(p)(F.col("path"))) for p in ("*.html", "fr/", "**/de/*")]
    return _pages(spark, sf).select("page_id", patterns.first_match(tests).alias("pattern"))


@query(f"""WITH x AS (SELECT string_split({_FULL}, '/') AS p, length(html) AS n FROM pages), u AS (SELECT unnest({_UP}) AS dir, n FROM x)
SELECT dir, count(*) AS pages, sum(n)::BIGINT AS chars, quantile_disc(n, 0.75) AS p75 FROM u GROUP BY dir""")
def ancestor_explode_rollup(spark, sf):
    aggs = [F.count("*").alias("pages"), F.sum("n").alias("chars"), hierarchy.nearest_rank("n", 0.75).cast("bigint").alias("p75")]
    return hierarchy.rollup_paths(_pages(spark, sf), "path", aggs)


_RANKED = f"""x AS (SELECT page_id, {_FULL} AS path, string_split({_FULL}, '/') AS p, length(html) AS n FROM pages), u AS (SELECT page_id, path, unnest({_UP}) AS dir, n FROM x),
d AS (SELECT dir, sum(n)::BIGINT AS s, count(*) AS c FROM u GROUP BY dir), k AS (SELECT dir, CASE WHEN c % 2 = 1 THEN s END AS rank FROM d)"""


def _ranked(spark, sf):
    """Directories of pages; those of an odd number of pages have a rank."""
    d = hierarchy.rollup_paths(_pages(spark, sf), "path", [F.sum("n").alias("s"), F.count("*").alias("c")])
    return d.select("dir", F.when(F.col("c") % 2 == 1, F.col("s")).alias("rank"))


@query(f"""WITH {_RANKED}
SELECT u.page_id, arg_max(k.rank, length(k.dir)) AS rank, 'inherited:' || arg_max(k.dir, length(k.dir)) AS rank_source FROM u LEFT JOIN k ON u.dir = k.dir AND k.rank IS NOT NULL GROUP BY u.page_id""")
def inherit_nearest_ancestor(spark, sf):
    return hierarchy.inherit_nearest(_pages(spark, sf).select("page_id", "path"), _ranked(spark, sf)).select("page_id", "rank", "rank_source")


@query(f"""WITH {_RANKED},
f AS (SELECT a.dir, b.dir AS below, b.rank FROM k a JOIN k b ON b.dir LIKE a.dir || '/%' AND b.rank IS NOT NULL
      WHERE NOT EXISTS (SELECT 1 FROM k m WHERE m.rank IS NOT NULL AND m.dir <> b.dir AND b.dir LIKE m.dir || '/%' AND (m.dir = a.dir OR m.dir LIKE a.dir || '/%')))
SELECT k.dir, coalesce(k.rank, max(f.rank)) AS rank, CASE WHEN k.rank IS NOT NULL THEN 'graph' WHEN max(f.rank) IS NOT NULL THEN 'children' END AS rank_source
FROM k LEFT JOIN f USING (dir) GROUP BY k.dir, k.rank""")
def children_max_rank(spark, sf):
    return hierarchy.rank_from_children(_ranked(spark, sf))


@query(f"""WITH x AS (SELECT page_id, {_FULL} AS path, string_split({_FULL}, '/') AS p FROM pages),
m AS (SELECT DISTINCT dir AS module FROM (SELECT unnest({_UP}) AS dir FROM x) WHERE length(dir) % 3 <> 0)
SELECT page_id, arg_max(module, length(module)) AS module FROM x LEFT JOIN m ON path = module OR path LIKE module || '/%' GROUP BY page_id""")
def longest_prefix_match(spark, sf):
    pages = _pages(spark, sf)
    modules = pages.select(F.explode(ancestors(F.col("path"))).alias("module")).filter("length(module) % 3 <> 0")
    return joins.longest_prefix(pages.select("page_id", "path"), "path", modules, "module").select("page_id", "module")


@query("""WITH x AS (SELECT r_name AS a, r_name || '/' || n_name AS b, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT a AS dir, c_acctbal FROM x UNION ALL SELECT b, c_acctbal FROM x)
SELECT dir, count(*) AS n, quantile_disc(c_acctbal, 0.75) AS p75, max(c_acctbal) AS most FROM u GROUP BY dir""")
def p75_rollup_region_nation(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = c.select(F.concat_ws("/", "r_name", "n_name", "c_custkey").alias("path"), "c_acctbal")
    return hierarchy.rollup_paths(files, "path", [F.count("*").alias("n"), hierarchy.nearest_rank("c_acctbal", 0.75).alias("p75"), F.max("c_acctbal").alias("most")])


@query("""WITH x AS (SELECT p_brand AS b, p_brand || '/' || p_type AS t, p_brand || '/' || p_type || '/' || p_partkey AS f, p_size FROM part),
u AS (SELECT '' AS id, 'dir' AS kind, p_size FROM x UNION ALL SELECT b, 'dir', p_size FROM x UNION ALL SELECT t, 'dir', p_size FROM x UNION ALL SELECT f, 'file', p_size FROM x)
SELECT id, kind, CASE WHEN id <> '' THEN regexp_replace(regexp_replace(id, '[^/]*$', ''), '/$', '') END AS parent, regexp_extract(id, '[^/]*$') AS name, sum(p_size)::BIGINT AS size FROM u GROUP BY id, kind""")
def tree_size_rollup(spark, sf):
    parts = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("path"), "p_size")
    return hierarchy.tree(parts, "path", [F.sum("p_size").alias("size")]).select("id", "kind", "parent", "name", "size")
