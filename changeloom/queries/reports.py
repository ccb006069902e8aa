"""Reports, texts and caches over documents, orders, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import texts
from changeloom.operators import decisions, evaluation, hierarchy, reports
from changeloom.queries import query, table
from changeloom.queries.decisions import _UNITS, _placed
from changeloom.sources import trees


@query("""WITH x AS (SELECT lang, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'rule' ELSE 'model' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'human' END AS bucket, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 40)::INT END AS impact, (doc_id % 60)::INT AS likelihood, (doc_id % 9)::INT AS attention FROM documents),
y AS (SELECT * FROM x WHERE NOT (source = 'rule' AND bucket = 'none'))
SELECT lang, arg_max(id, impact * 1000000 - id) AS impact_id, max(impact) AS impact, arg_max(id, likelihood * 1000000 - id) AS likelihood_id, max(likelihood) AS likelihood, max(attention) AS attention FROM y GROUP BY lang""")
def report_maxima(spark, sf):
    i = F.col("doc_id")
    x = table(spark, sf, "documents").select("lang", i.alias("id"), i.alias("ord"), F.when(i % 7 == 0, "rule").otherwise("model").alias("source"), F.when(i % 2 == 0, "none").otherwise("human").alias("bucket"), F.when(i % 5 != 0, (i % 40).cast("int")).alias("impact"), (i % 60).cast("int").alias("likelihood"), (i % 9).cast("int").alias("attention"))
    return reports.maxima(x, ["lang"])


@query("""WITH h AS (SELECT l_orderkey, (l_partkey % 90)::INT AS old_start, (l_suppkey % 4)::INT AS old_lines, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 100)::INT END AS impact FROM lineitem)
SELECT l_orderkey, greatest(coalesce(min(old_start) FILTER (old_start > 0), 0), 1) AS start, greatest(max(CASE WHEN old_lines = 0 THEN old_start + 1 ELSE old_start + old_lines - 1 END), 1) AS "end", coalesce(max(impact), 0) AS impact, count(*) AS hunks FROM h GROUP BY l_orderkey""")
def hunk_envelopes(spark, sf):
    """The lines that an order's hunks span, and the worst impact of them."""
    h = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90).cast("int").alias("old_start"), (F.col("l_suppkey") % 4).cast("int").alias("old_lines"), F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") % 100).cast("int")).alias("impact"))
    return reports.old_range(h, ["l_orderkey"]).join(reports.worst_impact(h, ["l_orderkey"]), "l_orderkey")


@query("""SELECT o_orderpriority AS repo, count(*) AS results, sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey % 3 END)::BIGINT AS human FROM orders GROUP BY 1""")
def human_units(spark, sf):
    human = F.when(F.col("o_orderstatus") != "O", F.col("o_custkey") % 3)
    return reports.human_units(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), human.alias("human")))


@query("""WITH s AS (SELECT lang, doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 16) / 16e0 END AS score FROM documents)
SELECT lang, count(score) AS n, avg(score) AS mean, array_to_string(list(id ORDER BY score, id) FILTER (score < 0.1), ',') AS low FROM s GROUP BY lang""")
def faithfulness(spark, sf):
    """A judge's scores of documents by language: the mean and the lowest."""
    i = F.col("doc_id")
    s = table(spark, sf, "documents").select("lang", i.alias("id"), F.when(i % 6 != 0, (i % 16) / 16.0).alias("score"))
    made = reports.faithfulness(s, ["lang"], 0.1)
    return made.select("lang", "n", "mean", F.concat_ws(",", F.col("low").cast("array<string>")).alias("low"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer), f AS (SELECT c_nationkey, list(c_custkey ORDER BY rn) AS ids FROM r WHERE rn <= 5 GROUP BY 1)
SELECT c_custkey, array_to_string(list_filter(ids, lambda x: x <> c_custkey)[1:4], ',') AS related FROM r JOIN f USING (c_nationkey)""")
def related_capped(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), "c_nationkey")
    return reports.related(c, ["c_nationkey"], most=4).select("c_custkey", F.concat_ws(",", F.col("related").cast("array<string>")).alias("related"))


@query(f"""WITH {_UNITS}, l AS (SELECT id // 200 AS change, bucket, list_position(['human', 'skim', 'none'], bucket) AS k, count(*) AS n, string_agg('- `' || id || '` (' || total || ') ' || change_kind, chr(10) ORDER BY id) AS body FROM placed WHERE budget = 'balanced' GROUP BY id // 200, bucket)
SELECT change, string_agg('## ' || ['Needs a person', 'Skim', 'No review'][k] || ' (' || n || ')' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY k) AS report FROM l GROUP BY change""")
def markdown_report(spark, sf):
    """A report for each change of two hundred units."""
    units = _placed(spark, sf).filter("budget = 'balanced'").select(F.floor(F.col("id") / 200).cast("bigint").alias("change"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), "bucket", "total", F.col("change_kind").alias("reason"))
    return reports.markdown(units, ["change"])


@query("""WITH x AS (SELECT source AS "case", list_position(['none', 'skim', 'human'], ['none', 'skim', 'human'][doc_id % 3 + 1]) AS g, CASE WHEN toxic = 1 THEN 3 WHEN quality = 1 THEN 1 ELSE 2 END AS s FROM documents JOIN labels USING (doc_id)),
r AS (SELECT "case", count(*) AS u, count(*) FILTER (g = s) AS e, count(*) FILTER (s = 3 AND g = 1) AS m, count(*) FILTER (g < s) AS lo, count(*) FILTER (g > s) AS hi FROM x GROUP BY 1)
SELECT "case", printf('%s: %d units, exact %d (%.1f%%), misses %d (%.1f%%), under %d (%.1f%%), over %d (%.1f%%)', "case", u, e, 100e0 * e / u, m, 100e0 * m / u, lo, 100e0 * lo / u, hi, 100e0 * hi / u) AS text FROM r""")
def eval_report(spark, sf):
    from changeloom.queries.decisions import _labelled

    return reports.eval_lines(evaluation.rates(_labelled(spark, sf), ["case"])).select("case", "text")


@query("""SELECT conv_id, count(*) AS turns, array_to_string(list_transform(CASE WHEN count(*) > 2 THEN [arg_min(turn, turn), arg_max(turn, turn)] ELSE list(turn ORDER BY turn) END, lambda x: x::VARCHAR), ',') AS ends FROM conversations GROUP BY conv_id""")
def chain_ends(spark, sf):
    chains = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list("turn")).alias("chain"))
    return chains.select("conv_id", "turns", F.concat_ws(",", reports.chain_ends(F.col("chain")).cast("array<string>")).alias("ends"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderdate DESC, o_orderkey) AS listed, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS sorted FROM orders""")
def list_orders(spark, sf):
    """The place of each order as a result by number and date, and in a table sorted by a column with nulls."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("number"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    first = decisions.places(o, [*reports.result_order(), F.asc("o_orderkey")], "listed").select("o_orderkey", "price", F.col("listed").cast("bigint"))
    return decisions.places(first, reports.table_order("price", name="o_orderkey"), "sorted").select("o_orderkey", "listed", F.col("sorted").cast("bigint"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '…' ELSE url END AS clipped FROM pages""")
def slug_and_clip(spark, sf):
    return table(spark, sf, "pages").select("page_id", texts.slug(F.col("url")).alias("slug"), texts.clip(F.col("url"), 20).alias("clipped"))


@query("""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM t)
SELECT doc_id, l[1] AS first, array_to_string(l[greatest(len(l) - 2, 1):], chr(10)) AS last FROM l""")
def first_and_last_lines(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", texts.first_line(t).alias("first"), texts.tail(t, 3).alias("last"))


@query("""WITH x AS (SELECT page_id, 'see https://git.example.com/o' || page_id % 5 || '/r' || page_id % 7 || '.git/pull/' || page_id || '/files' AS a, 'o/r#' || page_id AS b, 'https://' || 'api.example.com/shop/v1/items/' || page_id || '?x=1' AS u FROM pages)
SELECT page_id, 'git.example.com' AS host, 'o' || page_id % 5 AS owner, 'r' || page_id % 7 AS repo, page_id::INT AS number, 'home' AS short_host, 'shop' AS service, '/v1/items/' || page_id AS path FROM x""")
def references(spark, sf):
    """References to changes and URLs of services, read out of texts."""
    i = F.col("page_id").cast("string")
    long = F.concat(F.lit("see https://git.example.com/o"), (F.col("page_id") % 5).cast("string"), F.lit("/r"), (F.col("page_id") % 7).cast("string"), F.lit(".git/pull/"), i, F.lit("/files"))
    x = table(spark, sf, "pages").select("page_id", texts.change_reference(long, "home").alias("a"), texts.change_reference(F.concat(F.lit("o/r#"), i), "home").alias("b"), texts.service_urls(F.concat(F.lit("https://api.example.com/shop/v1/items/"), i, F.lit("?x=1")))[0].alias("u"))
    return x.select("page_id", "a.host", "a.owner", "a.repo", "a.number", F.col("b.host").alias("short_host"), "u.service", "u.path")


@query("""WITH x AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p, lead(string_split(regexp_replace(url, '[?#].*$', ''), '/')) OVER (ORDER BY url, page_id) AS q FROM pages)
SELECT page_id, len(list_filter(range(1, least(len(p), len(q))), lambda i: p[1:i] = q[1:i]))::INT AS depth FROM x WHERE q IS NOT NULL""")
def common_depth(spark, sf):
    """How many directories the URL of a page has in common with the next one's."""
    from pyspark.sql import Window

    plain = F.regexp_replace("url", "[?#].*$", "")
    x = table(spark, sf, "pages").select("page_id", plain.alias("p"), F.lead(plain).over(Window.orderBy("url", "page_id")).alias("q"))
    return x.filter("q IS NOT NULL").select("page_id", texts.common_depth(F.col("p"), F.col("q")).alias("depth"))


@query("""SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'region ' || n_regionkey END AS impact FROM nation""")
def renamed_key(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", "n_regionkey", texts.renamed(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("impact"))


@query("""WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN h ELSE 'old' END AS h FROM t WHERE doc_id % 2 = 0)
SELECT doc_id, c.h IS NOT NULL AS known FROM t LEFT JOIN c USING (doc_id, h)""")
def translation_cache(spark, sf):
    """Texts whose cached translation is of the text as it is, and the others."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    i = F.col("key")
    cache = t.filter(i % 2 == 0).select("key", F.lit("French").alias("language"), F.when(i % 3 == 0, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise("old").alias("hash"), F.lit("x").alias("translated"))
    known, wanted = trees.translations(t, cache, "French")
    return known.select(i.alias("doc_id"), F.lit(True).alias("known")).unionByName(wanted.select(i.alias("doc_id"), F.lit(False).alias("known")))


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) OR c_custkey % 10 = 0""")
def changed_repos(spark, sf):
    """Customers whose nation has no supplier with money, and every tenth, as graphs to be made again."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("repo"), F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(F.col("c_nationkey")).alias("fingerprint"), "c_nationkey")
    old = table(spark, sf, "customer").join(table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi")
    before = old.select(F.col("c_custkey").cast("string").alias("repo"), F.col("c_nationkey").alias("fingerprint"), F.lit(3).alias("version"))
    return trees.changed_repos(c, before, 3).select("c_custkey", "c_nationkey")


@query("""SELECT DISTINCT c_nationkey AS repo FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def stale_shards(spark, sf):
    shard = lambda t, c: table(spark, sf, t).select(F.col(c).alias("repo"))
    return trees.stale(shard("customer", "c_nationkey"), shard("supplier", "s_nationkey"), ["repo"])


@query("""SELECT DISTINCT c.c_mktsegment || c.c_nationkey AS repo, coalesce(n_name, 'unlisted') AS category FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def workspace_categories(spark, sf):
    found = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("repo"), "c_mktsegment", "c_nationkey")
    listed = found.join(table(spark, sf, "nation").filter("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("repo", F.col("n_name").alias("category")).distinct()
    return trees.workspace(listed, found)


@query("""WITH x AS (SELECT doc_id, ['none', 'skim', 'human'][doc_id % 3 + 1] AS now, doc_id % 4 = 0 AS reviewed, CASE WHEN doc_id % 5 <> 0 THEN ['none', 'skim', 'human'][doc_id % 2 + 1] END AS before FROM documents)
SELECT doc_id, CASE WHEN reviewed THEN now ELSE coalesce(before, now) END AS bucket FROM x""")
def carry_forward(spark, sf):
    i = F.col("doc_id")
    pick = lambda n: F.element_at(F.array(*map(F.lit, ["none", "skim", "human"])), (i % n + 1).cast("int"))
    d = table(spark, sf, "documents")
    fresh = d.select("doc_id", pick(3).alias("bucket"), (i % 4 == 0).alias("reviewed"))
    return decisions.carry_forward(fresh, d.filter(i % 5 != 0).select("doc_id", pick(2).alias("bucket")), ["doc_id"]).select("doc_id", "bucket")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_linenumber % 2 = 0 AND o_orderstatus = 'F')""")
def critic_filter(spark, sf):
    """Lines but those that an order's verdict calls invalid; missing verdicts keep theirs."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    verdicts = lines.filter("l_linenumber % 2 = 0").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", F.when(F.col("o_orderstatus") == "F", "invalid").when(F.col("o_orderstatus") == "O", "valid").alias("verdict"))
    return decisions.critic(lines, verdicts, ["l_orderkey", "l_linenumber"])


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 4 <> 0""")
def reviewable_units(spark, sf):
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", (i % 3).alias("n_hunks"), F.when(i % 4 == 0, "none").when(i % 4 == 1, "human").alias("pin"))
    return decisions.reviewable(rows).select("doc_id")


@query("""WITH u AS (SELECT DISTINCT source AS "case", doc_id::VARCHAR AS id, lang AS file FROM documents), o AS (SELECT DISTINCT source AS "case", doc_id::VARCHAR AS key, 'human' AS b FROM documents WHERE doc_id % 3 = 0), f AS (SELECT DISTINCT source AS "case", lang AS key, 'skim' AS b FROM documents WHERE lang <> 'en')
SELECT u."case", id, coalesce(o.b, f.b) AS label FROM u LEFT JOIN o ON o."case" = u."case" AND o.key = id LEFT JOIN f ON f."case" = u."case" AND f.key = file""")
def label_fallback(spark, sf):
    """The label of a unit, else that of its file."""
    d = table(spark, sf, "documents")
    case, i = F.col("source").alias("case"), F.col("doc_id").cast("string")
    units = d.select(case, i.alias("id"), F.col("lang").alias("file"), F.lit("skim").alias("bucket"))
    labels = d.filter("doc_id % 3 = 0").select(case, i.alias("key"), F.lit("human").alias("bucket")).unionByName(d.filter("lang <> 'en'").select(case, F.col("lang").alias("key"), F.lit("skim").alias("bucket")).distinct())
    return evaluation.with_labels(units, labels).select("case", "id", "label")


@query("""SELECT l_suppkey, l_returnflag AS tag, max(l_linenumber)::INT AS score FROM lineitem GROUP BY ALL""")
def merged_tags(spark, sf):
    tags = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("tag"), F.col("l_linenumber").cast("int").alias("score"), F.col("l_orderkey").alias("via"))
    return hierarchy.merge_tags(tags, ["l_suppkey"]).select("l_suppkey", "tag", "score")


@query("""SELECT o_orderkey, len(list(l_linenumber)) AS units, count(DISTINCT l_returnflag) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_result(spark, sf):
    """The stored shape of a result, counted again."""
    units = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"))
    made = reports.nested(units, ["o_orderkey"], ["line", "id"])
    return made.select("o_orderkey", F.aggregate("files", F.lit(0), lambda a, x: a + F.size(x["units"])).cast("bigint").alias("units"), F.size("files").cast("bigint").alias("files"))
