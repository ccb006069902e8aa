"""Triage of change sets: diffs to units, units to impact and likelihood, answers to buckets under a budget.

Models don't run here: what a classifier and a reviewer said comes in as tables, and a unit without an answer goes to a
person. Many change sets are triaged in one job.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import patterns
from changeloom.operators import change, decisions
from changeloom.plans.impact import unit_impacts
from changeloom.sources.diffs import parse_diff, units


#: A policy's patterns: what always goes to a person, and what is generated.
POLICY = {"force_human": ["**/migrations/**"], "generated": ["vendor/", "node_modules/", "*.pb.go", "*.gen.go", *patterns.LOCKFILES]}


def presort(rows: DataFrame, policy: dict | None = None) -> DataFrame:
    """units with rule: what a rule decides before any model (bucket, change_kind, reason), or null. The order of rules is the
    order of precedence.

    rows(file, symbol, status, lines, and if known: binary, attribute: whether .gitattributes mark the file as generated, head: its
    first characters, real: whether its diff without white space has changes, n_hunks).
    """
    rules, file = policy or POLICY, F.col("file")
    changed = F.transform(F.filter("lines", lambda x: x["op"] != " "), lambda x: F.concat(x["op"], x["text"]))
    value = lambda bucket, kind, reason: F.struct(F.lit(bucket).alias("bucket"), F.lit(kind).alias("change_kind"), F.lit(reason).alias("reason"))
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)
    any_of = lambda globs: reduce(or_, [patterns.policy_glob(g)(file) for g in globs], F.lit(False))
    lines = has("n_hunks", 1) > 0
    go = file.endswith(".go")
    cascade = [
        (any_of(rules["force_human"]), value("human", "config", "policy: always a person")),
        (has("binary", False), value("human", "binary", "binary file")),
        (any_of(rules["generated"]), value("none", "generated", "policy: generated")),
        (has("attribute", False), value("none", "generated", "attributes: generated")),
        ((F.col("status") != "deleted") & patterns.generated_header(has("head", "")), value("none", "generated", "header: generated")),
        ((F.col("status") == "renamed") & ~lines, value("none", "rename", "renamed as it was")),
        (lines & ~has("real", True), value("none", "format", "white space alone")),
        (go & (F.col("symbol") == "imports") & patterns.only_lines(changed, patterns.IMPORT_LINE, patterns.RUNS_CODE), value("none", "format", "imports alone")),
        (go & (F.col("symbol") == "") & patterns.only_lines(changed, patterns.PACKAGE_LINE), value("none", "format", "package clause alone")),
        (patterns.is_docs(file), value("skim", "docs", "documentation")),
    ]
    return rows.withColumn("rule", patterns.cascade(cascade))


def triage(diffs: DataFrame, declarations: DataFrame, records: DataFrame, rules: list[dict], repo: str, answers: DataFrame, issues: DataFrame, budget: str = "balanced", measures: DataFrame | None = None, policy: dict | None = None, marked: DataFrame | None = None, heads: DataFrame | None = None, real: DataFrame | None = None, most: int | None = None, base: DataFrame | None = None, most_chars: int = 24_000) -> DataFrame:
    """(change_id, id, file, impact, likelihood, prior, attention, total, bucket, ord) in the order in which units are looked at.

    diffs(change_id, text); declarations(change_id, path, name, start, end, ord); answers(change_id, id, bucket,
    change_kind, confidence); issues(change_id, id, severity), all of reviewed units; measures(change_id, path, and what
    change_likelihood takes of a file: history, complexity, experience, partners, tests), without which only the change
    itself is scored: its size and how far it is spread.

    An answer the classifier isn't sure enough of is one bucket higher, so is "none" for a unit of more than most_chars, which it saw cut.

    What rules look at besides the diff: marked(change_id, path), files that attributes mark as generated; heads(change_id, path,
    head), the first characters of files; real(change_id, path), files that still change when white space doesn't count
    (``sources.trees``). Without a table its rule doesn't fire.

    base(change_id, path, name, start, end, ord): declarations of the base side. With it a unit's impact is looked up by every
    declaration it touches there, the highest counts; without it, units without a name are placed by the map's lines.
    """
    files, lines = parse_diff(diffs)
    own = files.select("change_id", "file_ord", "binary")
    made = units(files, lines, declarations, most).join(own, ["change_id", "file_ord"])
    for table, column in ((marked, "attribute"), (real, "real")):
        if table is not None:
            flag = table.select("change_id", F.col("path").alias("file")).distinct().withColumn(column, F.lit(True))
            made = made.join(flag, ["change_id", "file"], "left").withColumn(column, F.coalesce(column, F.lit(False)))
    if heads is not None:
        made = made.join(heads.select("change_id", F.col("path").alias("file"), "head"), ["change_id", "file"], "left")
    made = presort(made, policy)
    made = made.withColumn("chars", F.aggregate("lines", F.lit(0), lambda a, x: a + F.octet_length(x["text"]) + 2))
    looked = unit_impacts(made, base, records, rules, repo)
    known = made.join(looked.select("change_id", "id", F.when(F.col("matched") != "none", F.col("impact")).alias("impact")), ["change_id", "id"])
    said = answers.select("change_id", "id", F.col("bucket").alias("_b"), F.col("change_kind").alias("_k"), F.col("confidence").alias("_c"))
    x = known.join(said, ["change_id", "id"], "left")
    pick = lambda rule, answer, default: F.coalesce(rule, answer, F.lit(default))
    answered = decisions.escalate(F.col("_b"), F.coalesce("_c", F.lit(0.0)), F.col("chars") > most_chars)
    x = x.withColumns({
        "bucket": pick(F.col("rule.bucket"), answered, "human"),
        "change_kind": pick(F.col("rule.change_kind"), F.col("_k"), "behavior"),
        "source": F.when(F.col("rule").isNotNull(), "rule").when(F.col("_b").isNull(), "none").otherwise("model"),
        "confidence": F.when(F.col("rule").isNotNull(), 1.0).otherwise(F.coalesce("_c", F.lit(0.0))),
        "risk_signals": F.array().cast("array<string>"),
    })
    x = likelihoods(x, files, measures)
    scored = decisions.score_units(x, most_chars)
    found = issues.groupBy("change_id", "id").agg(F.collect_list("severity").alias("severities"))
    reviewed = scored.join(found, ["change_id", "id"], "left").withColumns({"severities": F.coalesce("severities", F.array().cast("array<string>")), "reviewed": F.lit(True), "review_failed": F.lit(False)})
    after = decisions.after_review(reviewed).withColumn("pin", F.when(F.col("source") == "rule", F.col("classified")).otherwise(F.col("pin")))
    under = decisions.budgets(diffs.sparkSession).filter(F.col("budget") == budget)
    placed = decisions.place(after.drop("bucket"), under)
    w = Window.partitionBy("change_id").orderBy(*decisions.bucket_order(placed, "id"))
    return placed.select("change_id", "id", "file", "impact", "likelihood", "prior", "attention", "total", "bucket", F.row_number().over(w).alias("ord"))


#: What change_likelihood takes of a file, with its type.
MEASURES = {"generated": "boolean", "recent_fixes": "double", "reverts": "bigint", "recent": "double", "authors": "bigint", "dir_fixes": "double", "cyclo": "int", "nest": "int", "delta": "int", "file_commits": "bigint", "repo_commits": "bigint", "n_missing": "int", "test_gap": "boolean", "fix_pr": "boolean"}


def likelihoods(x: DataFrame, files: DataFrame, measures: DataFrame | None) -> DataFrame:
    """x(change_id, file, added, removed, source, bucket) with the likelihood of each unit."""
    known = [] if measures is None else measures.columns
    of_file = files.select("change_id", F.col("path").alias("file")).distinct() if measures is None else measures.withColumnRenamed("path", "file")
    of_file = of_file.select("change_id", "file", *[(F.col(c) if c in known else F.lit(None).cast(t)).alias(c) for c, t in MEASURES.items()])
    met = x.join(of_file, ["change_id", "file"], "left").join(change.spread(files), "change_id", "left")
    met = met.withColumns({"path": F.col("file"), "changed": F.col("added") + F.col("removed"), "skipped": (F.col("source") == "rule") & (F.col("bucket") == "none"), "generated": F.coalesce("generated", F.lit(False))})
    return change.change_likelihood(met).select(*x.columns, "likelihood", "likelihood_level", "factors")
