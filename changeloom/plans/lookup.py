"""Lookups in a map: symbol, class, lines, file, nearest directory, repository, whichever first has a record.

All queries are answered in one job: each level is an equi-join, the levels are unioned, and the best is picked for
each query by one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors, level, normal_symbol, round_half_away
from changeloom.operators.joins import match_rules

_KEPT = ["id", "impact", "rank", "rollback", "impact_cap"]
_CLASSES = r"\.[cm]?[jt]sx?$"


def fallback_lookup(queries: DataFrame, records: DataFrame, rules: list[dict], w_rank: float = 0.55, w_rollback: float = 0.45) -> DataFrame:
    """(qid, matched, basis, chain, impact, impact_level, rollback) of queries(qid, repo, path, sym?, lo?, hi?, new_file).

    Instead of sym there may be syms, several names in order: each is looked up as if alone, those with a record are the
    answer together, the one of the highest impact first, and lines don't count.
    A new file has no record, symbol or lines of its own. What isn't in the map is estimated from half its ancestor's
    rank and the path rules' scores; a rule with a cap (tests, docs) takes the ancestor's rollback away. The cap of a
    path rule goes before the record's.
    """
    fresh = F.coalesce("new_file", F.lit(False))
    given = F.col("syms") if "syms" in queries.columns else F.array("sym")
    q = queries.select(
        "qid", "repo", F.regexp_replace(F.regexp_replace("path", r"/{2,}", "/"), r"^/|/$", "").alias("path"),
        F.when(~fresh, F.filter(given, lambda x: x.isNotNull())).alias("syms"), *[F.when(~fresh, F.col(c)).alias(c) for c in ("lo", "hi")], fresh.alias("new_file"),
    )
    r = records.select("repo", "level", F.col("path").alias("_path"), normal_symbol(F.col("sym")).alias("_sym"), "lines", F.struct(*_KEPT).alias("rec"))
    symbols = r.filter("level = 'symbol'")
    tagged = lambda df, order, depth, place=F.lit(0): df.select("qid", order.alias("level_order"), depth.alias("depth"), place.alias("place"), "rec")
    none = F.lit(0)
    name = normal_symbol(F.col("_name"))
    outer = F.when(F.col("_path").rlike(_CLASSES) & name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))
    tries = F.explode(F.array(F.struct(F.lit(0).alias("order"), name.alias("sym")), F.struct(F.lit(1).alias("order"), outer.alias("sym"))))
    named = q.select("qid", "repo", F.col("path").alias("_path"), F.posexplode("syms").alias("place", "_name")).select("qid", "repo", "_path", "place", tries.alias("_try"))
    named = named.select("qid", "repo", "_path", "place", F.col("_try.order").alias("order"), F.col("_try.sym").alias("_sym")).filter("_sym IS NOT NULL")
    by_name = tagged(named.join(symbols, ["repo", "_path", "_sym"]), F.col("order"), none, F.col("place"))
    lined = q.filter("lo > 0").withColumn("_hi", F.greatest("lo", F.coalesce("hi", "lo")))
    near = lined.join(symbols.filter("size(lines) = 2"), (lined["repo"] == symbols["repo"]) & (lined["path"] == symbols["_path"])).filter("lines[0] <= _hi AND lines[1] >= lo")
    by_line = tagged(near, F.lit(2), none)
    ids = lambda lvl: r.filter(F.col("level") == lvl).select(F.col("rec.id").alias("_id"), "rec")
    by_file = tagged(q.filter("NOT new_file").withColumn("_id", F.concat_ws("/", "repo", "path")).join(ids("file"), "_id"), F.lit(3), none)
    above = q.select("qid", "repo", F.explode(ancestors(F.col("path"))).alias("_dir"))
    by_dir = tagged(above.withColumn("_id", F.concat(F.col("repo"), F.lit("/"), F.col("_dir"), F.lit("/"))).join(ids("dir"), "_id"), F.lit(4), F.length("_dir"))
    by_repo = tagged(q.withColumn("_id", F.col("repo")).join(ids("repo"), "_id"), F.lit(5), none)
    every = by_name
    for other in (by_line, by_file, by_dir, by_repo):
        every = every.unionByName(other)
    item = F.struct("level_order", (-F.col("depth")).alias("shallow"), (-F.col("rec.impact")).alias("minus"), "place", F.col("rec.id").alias("id"), "rec")
    sorted_ = every.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    exact = F.transform(F.filter("all", lambda x: x["level_order"] == 0), lambda x: x["place"])
    of_name = F.filter("all", lambda x: (x["level_order"] == 0) | ((x["level_order"] == 1) & ~F.array_contains(exact, x["place"])))
    sorted_ = sorted_.withColumn("names", F.array_sort(F.transform(of_name, lambda x: F.struct(x["minus"].alias("minus"), x["place"].alias("place"), x["id"].alias("id"), x["rec"].alias("rec")))))
    best, there = F.col("all")[0], F.size("names") > 0
    is_best = lambda x: (x["level_order"] == best["level_order"]) & (x["shallow"] == best["shallow"])
    found = sorted_.select(
        "qid", best["level_order"].alias("_lvl"), F.when(there, F.try_element_at("names", F.lit(1))["rec"]).otherwise(best["rec"]).alias("top"),
        F.when(there, F.array_distinct(F.transform("names", lambda x: x["id"]))).otherwise(F.transform(F.filter("all", is_best), lambda x: x["id"])).alias("basis"),
        F.transform(F.filter("all", lambda x: (x["level_order"] >= 3) & ~is_best(x)), lambda x: x["id"]).alias("chain"),
    )
    met = match_rules(q.select("qid", "repo", "path"), rules).groupBy("qid").agg(F.max("rule_score").alias("_score"), F.min("rule_cap").alias("_cap"), F.max("rule_floor").alias("_floor"))
    x = q.select("qid").join(found, "qid", "left").join(met, "qid", "left")
    known = F.col("_lvl") <= 3
    rollback = F.when(known, F.col("top.rollback")).otherwise(F.greatest(F.when(F.col("_cap").isNotNull(), 0).otherwise(F.col("top.rollback")), F.coalesce("_score", F.lit(0))))
    guess = F.greatest(round_half_away(w_rank * F.coalesce(F.col("top.rank"), F.lit(0.0)) * 0.5 + w_rollback * rollback).cast("int"), F.coalesce("_floor", F.lit(0)))
    impact = F.when(known, F.col("top.impact")).otherwise(guess)
    cap = F.coalesce("_cap", "top.impact_cap")
    names = F.element_at(F.array(*map(F.lit, ["symbol", "symbol", "symbol", "file", "dir", "repo"])), F.col("_lvl") + 1)
    there = F.col("_lvl").isNotNull()
    out = x.withColumns({"matched": F.when(there, names).otherwise("none"), "rollback": F.when(there, rollback), "impact": F.when(there, F.least(impact, F.coalesce(cap, impact)))})
    return out.select("qid", "matched", "basis", "chain", "impact", F.when(F.col("matched") == "none", "low").otherwise(level(F.col("impact"))).alias("impact_level"), "rollback")


def lookup_lines(lines: DataFrame, files: DataFrame, records: DataFrame, rules: list[dict], repo: str) -> DataFrame:
    """Answers for the changed runs of parsed diffs: a query for each hunk, by the lines it adds."""
    spans = lines.filter("op = '+'").groupBy("change_id", "file_ord", "hunk_ord").agg(F.min("new_no").alias("lo"), F.max("new_no").alias("hi"))
    q = spans.join(files, ["change_id", "file_ord"]).select(F.xxhash64("change_id", "file_ord", "hunk_ord").alias("qid"), "change_id", "path", "lo", "hi", (F.col("status") == "added").alias("new_file"), F.lit(repo).alias("repo"), F.lit(None).cast("string").alias("sym"))
    return q.select("qid", "change_id", "path").join(fallback_lookup(q, records, rules), "qid")
