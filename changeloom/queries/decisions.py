"""Rules, scores, placement and evaluation over parts, suppliers, orders, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions.scalars import blend, level, points, tally
from changeloom.operators import decisions, evaluation, hierarchy, joins
from changeloom.queries import query, table

RULES = [
    {"id": "steel", "score": 60, "path": ["**/*STEEL*/*"]},
    {"id": "brand-one", "score": 45, "floor": 55, "path": ["{Brand#11,Brand#12,Brand#13}/**"]},
    {"id": "small", "score": 20, "cap": 30, "p_size": [1, 2, 3]},
    {"id": "not-promo", "score": 40, "path": ["**"], "not_path": ["*/PROMO*/**"]},
]
_RULES_SQL = """x AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name AS path, p_size FROM part),
m AS (SELECT p_partkey, 'steel' AS rule_id, 60 AS rule_score, NULL::INT AS rule_cap, 0 AS rule_floor FROM x WHERE regexp_matches(path, '^(?:.*/)?[^/]*STEEL[^/]*/[^/]*$')
UNION ALL SELECT p_partkey, 'brand-one', 45, NULL, 55 FROM x WHERE regexp_matches(path, '^(?:Brand#11|Brand#12|Brand#13)/.*$')
UNION ALL SELECT p_partkey, 'small', 20, 30, 0 FROM x WHERE p_size IN (1, 2, 3)
UNION ALL SELECT p_partkey, 'not-promo', 40, NULL, 0 FROM x WHERE NOT regexp_matches(path, '^[^/]*/PROMO[^/]*/.*$'))"""


def _matches(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path"), "p_size")
    return joins.match_rules(parts, RULES)


@query(f"WITH {_RULES_SQL} SELECT * FROM m")
def rule_cross_tags(spark, sf):
    return _matches(spark, sf).select("p_partkey", "rule_id", "rule_score", "rule_cap", "rule_floor")


@query(f"""WITH {_RULES_SQL}, t AS (SELECT p_partkey, max(rule_score) AS best, count(*) FILTER (rule_score >= 40) AS many, min(rule_cap) AS cap, max(rule_floor) AS flo FROM m GROUP BY 1)
SELECT p_partkey, least(100, greatest(10, best) + 3 * greatest(0, many - (best >= 40)::INT))::INT AS rollback, cap, flo AS floor FROM t""")
def rollback_score_bonus(spark, sf):
    tags = _matches(spark, sf).select("p_partkey", F.col("rule_id").alias("tag"), F.col("rule_score").alias("score"), "rule_cap", "rule_floor")
    bounds = tags.groupBy("p_partkey").agg(F.min("rule_cap").alias("cap"), F.max("rule_floor").alias("floor"))
    return hierarchy.rollback_score(tags, ["p_partkey"]).join(bounds, "p_partkey")


@query("""SELECT s_suppkey, floor(s_acctbal / 100)::INT AS score, CASE WHEN floor(s_acctbal / 100) >= 75 THEN 'critical' WHEN floor(s_acctbal / 100) >= 55 THEN 'high' WHEN floor(s_acctbal / 100) >= 35 THEN 'medium' ELSE 'low' END AS level FROM supplier""")
def level_banding(spark, sf):
    score = F.floor(F.col("s_acctbal") / 100).cast("int")
    return table(spark, sf, "supplier").select("s_suppkey", score.alias("score"), level(score).alias("level"))


@query("""SELECT o_orderkey, least(30e0, greatest(0e0, o_totalprice / 1e4 - 3e0) * 1.25e0) AS points FROM orders""")
def capped_points(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", points(F.col("o_totalprice") / 1e4, 1.25, 3, 30).alias("points"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice / 20e0 AS rank, p_size * 2 AS rb, CASE WHEN p_size % 7 = 0 THEN 60 END AS f, CASE WHEN p_size % 5 = 0 THEN 25 END AS c FROM part),
b AS (SELECT *, floor(0.55e0 * rank + 0.45e0 * rb + 0.5e0)::INT AS s FROM x)
SELECT p_partkey, least(greatest(s, coalesce(f, s)), coalesce(c, greatest(s, coalesce(f, s)))) AS impact FROM b""")
def impact_blend_floor_cap(spark, sf):
    size = F.col("p_size")
    impact = blend(F.col("p_retailprice") / 20.0, size * 2, F.when(size % 7 == 0, 60), F.when(size % 5 == 0, 25))
    return table(spark, sf, "part").select("p_partkey", impact.alias("impact"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1),
f AS (SELECT o_custkey, least(30e0, greatest(0e0, urgent) * 12e0) AS a, least(10e0, greatest(0e0, n - 3e0)) AS b, least(8e0, greatest(0e0, kinds - 2e0) * 2e0) AS c FROM o)
SELECT o_custkey, least(100, floor(CASE WHEN a >= 0.5e0 THEN a ELSE 0e0 END + CASE WHEN b >= 0.5e0 THEN b ELSE 0e0 END + CASE WHEN c >= 0.5e0 THEN c ELSE 0e0 END + 0.5e0)::INT) AS score FROM f""")
def tally_score_factors(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.countDistinct("o_orderstatus").alias("kinds"))
    measures = {"fixes": F.col("urgent"), "churn": F.col("n"), "authors": F.col("kinds")}
    return o.select("o_custkey", tally(decisions.factors(measures, decisions.PLACE_POINTS)).alias("score"))


def _units(spark, sf):
    """Documents with a label as units: impact by length, likelihood by id, what a classifier would have said."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    i = F.col("doc_id")
    said = F.element_at(F.array(F.lit("none"), F.lit("skim"), F.lit("human")), (i % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("behavior"), F.lit("test"), F.lit("docs"), F.lit("refactor")), (i % 4 + 1).cast("int"))
    impact = F.when(i % 11 != 0, F.least(F.lit(100), (F.col("n_chars") / 100).cast("int")))
    return d.select(
        i.alias("id"), impact.alias("impact"), (i % 97).cast("int").alias("likelihood"), kind.alias("change_kind"), said.alias("bucket"),
        F.when(i % 13 == 0, "rule").otherwise("model").alias("source"), ((i % 10) / 10.0).alias("confidence"),
        F.array().cast("array<string>").alias("risk_signals"), F.col("n_chars").alias("chars"), "quality", "toxic",
    )


_UNITS = """d AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN least(100, trunc(n_chars / 100)::INT) END AS impact, (doc_id % 97)::INT AS likelihood,
 ['behavior', 'test', 'docs', 'refactor'][doc_id % 4 + 1] AS change_kind, ['none', 'skim', 'human'][doc_id % 3 + 1] AS bucket,
 CASE WHEN doc_id % 13 = 0 THEN 'rule' ELSE 'model' END AS source, (doc_id % 10) / 10e0 AS confidence, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, CASE change_kind WHEN 'behavior' THEN 1e0 WHEN 'test' THEN 0.8e0 WHEN 'docs' THEN 0.3e0 ELSE 0.6e0 END AS w, floor(sqrt(coalesce(impact, 50)::DOUBLE * likelihood) + 0.5e0) AS base FROM d),
p AS (SELECT *, floor(base * CASE bucket WHEN 'human' THEN greatest(w, 0.8e0) WHEN 'none' THEN least(w, 0.3e0) ELSE w END + 0.5e0)::INT AS prior,
 CASE WHEN source = 'rule' THEN bucket WHEN confidence = 0 THEN 'human' WHEN impact IS NULL THEN bucket WHEN impact >= 85 THEN 'human' END AS pin,
 CASE WHEN change_kind = 'behavior' OR (bucket = 'human' AND source <> 'rule') OR n_chars > 24000 THEN 'skim' END AS flo,
 CASE WHEN toxic = 1 THEN 45 ELSE 0 END AS attention, CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END AS clean FROM k),
b AS (SELECT * FROM (VALUES ('most', 0e0, 30, 10), ('more', 0.15e0, 35, 12), ('balanced', 0.3e0, 40, 15), ('less', 0.45e0, 45, 18), ('least', 0.6e0, 50, 20)) AS t(budget, trust, human_at, skim_at)),
t AS (SELECT *, greatest(attention, floor(prior * (1 - trust * clean) + 0.5e0)::INT) AS total FROM p, b),
placed AS (SELECT * EXCLUDE (bucket), bucket AS said, coalesce(pin, ['none', 'skim', 'human'][greatest(CASE WHEN total >= human_at THEN 3 WHEN total >= skim_at THEN 2 ELSE 1 END, CASE WHEN flo IS NULL THEN 1 ELSE 2 END)]) AS bucket FROM t)"""


def _placed(spark, sf):
    scored = decisions.score_units(_units(spark, sf)).withColumns({"attention": F.when(F.col("toxic") == 1, 45).otherwise(0), "clean": F.when(F.col("quality") == 1, 1.0).otherwise(0.0)})
    return decisions.place(scored.drop("bucket"), decisions.budgets(spark))


@query(f"WITH {_UNITS} SELECT id, base::INT AS base, prior, pin, flo AS floor FROM p")
def bucket_prior(spark, sf):
    return decisions.score_units(_units(spark, sf)).select("id", "base", "prior", "pin", "floor")


@query(f"WITH {_UNITS} SELECT id, budget, total, bucket FROM placed")
def bucket_place(spark, sf):
    return _placed(spark, sf).select("id", "budget", "total", "bucket")


@query(f"""WITH {_UNITS}
SELECT budget, count(*) FILTER (bucket = 'human') AS human, count(*) FILTER (bucket = 'skim') AS skim, count(*) FILTER (bucket = 'none') AS "none",
 count(*) FILTER (list_position(['none', 'skim', 'human'], bucket) < list_position(['none', 'skim', 'human'], said)) AS under, coalesce(sum(toxic) FILTER (bucket = 'none'), 0)::BIGINT AS hidden
FROM placed GROUP BY budget""")
def budget_whatif(spark, sf):
    rows = _placed(spark, sf).withColumn("label", F.col("classified")).withColumn("n_issues", F.col("toxic").cast("bigint"))
    return evaluation.what_if(rows)


@query(f"""WITH {_UNITS}
SELECT id, row_number() OVER (ORDER BY list_position(['none', 'skim', 'human'], bucket) DESC, total DESC, coalesce(impact, 50) * likelihood DESC, id) AS place FROM placed WHERE budget = 'balanced'""")
def bucket_order(spark, sf):
    """The place of every unit under the balanced budget."""
    return bucket_order_all(spark, sf)


@query(f"""WITH {_UNITS}
SELECT id, row_number() OVER (ORDER BY list_position(['none', 'skim', 'human'], bucket) DESC, total DESC, coalesce(impact, 50) * likelihood DESC, id) AS place FROM placed WHERE budget = 'balanced'""")
def bucket_order_all(spark, sf):
    """The place of every unit under the balanced budget."""
    rows = _placed(spark, sf).filter("budget = 'balanced'")
    return decisions.places(rows, decisions.bucket_order(rows, "id")).select("id", F.col("place").cast("bigint").alias("place"))


@query("""WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 75 WHEN 'A' THEN 45 ELSE 15 END AS w FROM lineitem)
SELECT l_orderkey, least(100, max(w) + 5 * (count(*) - 1))::INT AS attention FROM x GROUP BY 1""")
def attention_worst_plus(spark, sf):
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(severity).alias("s"))
    return lists.select("l_orderkey", decisions.attention(F.col("s")).alias("attention"))


_EVAL = """x AS (SELECT doc_id, source AS "case", ['none', 'skim', 'human'][doc_id % 3 + 1] AS bucket, CASE WHEN toxic = 1 THEN 'human' WHEN quality = 1 THEN 'none' ELSE 'skim' END AS label FROM documents JOIN labels USING (doc_id))"""


def _labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    said = F.when(F.col("toxic") == 1, "human").when(F.col("quality") == 1, "none").otherwise("skim")
    bucket = F.element_at(F.array(F.lit("none"), F.lit("skim"), F.lit("human")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", F.col("source").alias("case"), bucket.alias("bucket"), said.alias("label"))


@query(f"""WITH {_EVAL} SELECT label, count(*) FILTER (bucket = 'human') AS human, count(*) FILTER (bucket = 'skim') AS skim, count(*) FILTER (bucket = 'none') AS "none" FROM x GROUP BY label""")
def confusion_pivot(spark, sf):
    return evaluation.confusion(_labelled(spark, sf))


@query(f"""WITH {_EVAL}, y AS (SELECT "case", list_position(['none', 'skim', 'human'], bucket) AS g, list_position(['none', 'skim', 'human'], label) AS s FROM x)
SELECT "case", count(*) AS units, count(*) FILTER (g = s) AS exact, count(*) FILTER (s = 3 AND g = 1) AS misses, count(*) FILTER (g < s) AS under, count(*) FILTER (g > s) AS over FROM y GROUP BY "case" """)
def eval_rates(spark, sf):
    return evaluation.rates(_labelled(spark, sf), ["case"])


@query("""
WITH i AS (SELECT source AS "case", doc_id AS issue_id, lang, ['low', 'medium', 'high'][doc_id % 3 + 1] AS severity, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT DISTINCT source AS "case", lang, CASE WHEN lang = 'en' THEN 'must_not' ELSE 'must_find' END AS kind FROM documents),
m AS (SELECT i.*, r.kind, (i.severity <> 'low') AS within FROM i JOIN r USING ("case", lang) WHERE i.toxic = 1)
SELECT r."case", r.lang AS rule_id, CASE WHEN bool_or(m.within) THEN 'found' WHEN count(m.issue_id) > 0 THEN 'wrong severity' ELSE 'missed' END AS outcome
FROM r LEFT JOIN m ON m."case" = r."case" AND m.lang = r.lang GROUP BY 1, 2""")
def finding_recall(spark, sf):
    """Toxic documents as issues found, rules by source and language: each found, of the wrong severity or missed."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    severity = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("doc_id") % 3 + 1).cast("int"))
    issues = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("case"), F.col("doc_id").alias("issue_id"), F.col("doc_id").cast("string").alias("unit_id"), F.col("lang").alias("file"), severity.alias("severity"), F.when(F.col("toxic") == 1, "Toxic text").otherwise("fine").alias("title"))
    kind = F.when(F.col("lang") == "en", "must_not").otherwise("must_find")
    rules = d.select(F.col("source").alias("case"), F.col("lang").alias("rule_id"), F.col("lang").alias("key"), kind.alias("kind"), F.lit("toxic").alias("match"), F.lit("medium").alias("min_severity"), F.lit(None).cast("string").alias("max_severity")).distinct()
    return evaluation.findings(rules, issues)[0].select("case", "rule_id", "outcome")
