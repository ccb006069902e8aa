"""Decisions: priors with pins and floors, placement under budgets, after-review moves, escalation, likelihood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.functions.scalars import points, prior_base, tally, total, whole
from changeloom.functions.texts import drop_nulls
from changeloom.session import cut

# Fixed values of the scoring.
BUDGETS = {"most": (0.0, 30, 10), "more": (0.15, 35, 12), "balanced": (0.3, 40, 15), "less": (0.45, 45, 18), "least": (0.6, 50, 20)}
KIND_WEIGHTS = {"behavior": 1.0, "config": 1.0, "test": 0.8, "refactor": 0.6, "rename": 0.5, "docs": 0.3, "format": 0.3, "generated": 0.3}
SEVERITY = {"low": 15, "medium": 45, "high": 75, "critical": 95}
CRITICAL_IMPACT = 85
CONFIDENCE = {"none": 0.9, "skim": 0.7}
#: (points each, from, at most) of a place's likelihood, by the name of the measure.
PLACE_POINTS = {"fixes": (12, 0, 30), "reverts": (15, 0, 20), "churn": (1, 3, 10), "authors": (2, 2, 8), "dir_fixes": (2, 0, 6), "cyclo": (1.25, 5, 22), "nest": (4, 3, 10)}
CHANGE_POINTS = {"cyclo_delta": (2, 0, 14), "size": (0.05, 20, 6), "new_to_file": (8, 0, 8), "newcomer": (6, 0, 6), "cochange": (5, 0, 10), "test_gap": (6, 0, 6), "diffusion": (1, 3, 6), "fix_pr": (4, 0, 4)}

_NAMES = ["none", "skim", "human"]


def rank_of(bucket: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _NAMES)), bucket).cast("int") - 1


def name_of(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, _NAMES)), rank + 1))


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def severity_weight(severity: Column) -> Column:
    return lookup(SEVERITY, severity, 0).cast("int")


def attention(severities: Column) -> Column:
    """The worst severity's weight and 5 for each further issue, at most 100; 0 without issues."""
    worst = F.coalesce(F.array_max(F.transform(severities, severity_weight)), F.lit(0))
    return F.when(worst == 0, 0).otherwise(F.least(F.lit(100), worst + 5 * (F.size(severities) - 1))).cast("int")


def factors(measures: dict[str, Column], table: dict[str, tuple[float, float, float]]) -> Column:
    """The points of each measure, in the order of the table."""
    return F.array(*[points(F.coalesce(measures[k], F.lit(0)), *table[k]) for k in table if k in measures])


def likelihood(measures: dict[str, Column], table: dict[str, tuple[float, float, float]], zero: Column | None = None) -> Column:
    """The tally of the factors; 0 where ``zero`` holds (generated code, tests, what a rule has skipped)."""
    score = tally(factors(measures, table))
    return score if zero is None else F.when(zero, 0).otherwise(score)


def escalate(bucket: Column, confidence: Column, cut_off: Column, thresholds: dict[str, float] = CONFIDENCE) -> Column:
    """One bucket up for little confidence in it, or for "none" of a text that was cut; never down. Null stays null."""
    unsure = confidence < lookup(thresholds, bucket, 0.0)
    up = rank_of(bucket) + (unsure | (cut_off & (bucket == "none"))).cast("int")
    return name_of(F.when(bucket.isNotNull(), F.least(F.lit(2), up)))


def score_units(units: DataFrame, most_chars: int = 24_000) -> DataFrame:
    """units(impact?, likelihood?, change_kind, bucket, source, confidence, risk_signals, chars) with prior, pin, floor."""
    d = F.col("bucket")
    weight = lookup(KIND_WEIGHTS, F.col("change_kind"), 1.0)
    kind = F.when(d == "human", F.greatest(weight, F.lit(0.8))).when(d == "none", F.least(weight, F.lit(0.3))).otherwise(weight)
    base = prior_base(F.col("impact"), F.col("likelihood"))
    pin = (
        F.when(F.col("source") == "rule", d)
        .when((F.col("source") == "none") | (F.col("confidence") == 0), "human")
        .when(F.col("impact").isNull(), d)
        .when(F.col("impact") >= CRITICAL_IMPACT, "human")
    )
    asked = (F.col("change_kind") == "behavior") | ((d == "human") & (F.col("source") != "rule")) | (F.size("risk_signals") > 0) | (F.col("chars") > most_chars)
    return units.withColumns({"base": base, "kind": kind, "classified": d, "pin": pin, "floor": F.when(asked, "skim")}).withColumn("prior", whole(F.col("base") * F.col("kind")))


def budgets(spark: SparkSession, table: dict[str, tuple[float, int, int]] = BUDGETS) -> DataFrame:
    """A row a budget: a handful, so it is broadcast where it is joined."""
    return spark.createDataFrame([(k, *v, i) for i, (k, v) in enumerate(table.items())], "budget string, trust double, human_at int, skim_at int, budget_order int")


def place(units: DataFrame, under: DataFrame) -> DataFrame:
    """A row for each unit and budget: total and bucket. units(prior, clean, attention, pin?, floor?)."""
    rows = units.crossJoin(F.broadcast(under)).withColumn("total", total(F.col("prior"), F.col("trust"), F.col("clean"), F.col("attention")))
    by_cut = F.when(F.col("total") >= F.col("human_at"), 2).when(F.col("total") >= F.col("skim_at"), 1).otherwise(0)
    raised = F.greatest(by_cut, F.coalesce(rank_of(F.col("floor")), F.lit(0)))
    return rows.withColumn("bucket", F.coalesce(F.col("pin"), name_of(raised)))


def after_review(units: DataFrame) -> DataFrame:
    """units(severities, reviewed, pin?, escalated by a failed review?) with attention, clean and the pin the review gives."""
    worst = F.coalesce(F.array_max(F.transform("severities", severity_weight)), F.lit(0))
    found = worst >= SEVERITY["medium"]
    pinned = F.when(F.col("review_failed") | ~F.col("reviewed") | found, "human").otherwise(F.col("pin"))
    clean = F.when(~F.col("reviewed"), 0.0).when(F.size("severities") == 0, 1.0).when(worst == SEVERITY["low"], 0.5).otherwise(0.0)
    return units.withColumns({"attention": attention(F.col("severities")), "clean": clean, "pin": pinned})


def reviewable(units: DataFrame) -> DataFrame:
    """Units with lines that no rule has skipped."""
    return units.filter((F.col("n_hunks") > 0) & ~F.coalesce(F.col("pin") == "none", F.lit(False)))


def bucket_order(units: DataFrame, order: str = "ord") -> list[Column]:
    """Human first, then the higher total, then the higher risk, then as they came."""
    risk = F.coalesce("impact", F.lit(50)) * F.coalesce("likelihood", F.lit(50))
    return [F.desc(rank_of(F.col("bucket"))), F.desc("total"), risk.desc(), F.asc(order)]


def places(units: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """units with the place of each in an order of all, from 1. Rows are range-dealt and numbered in their parts; the
    sizes of the parts before (a row a part) are added."""
    dealt = cut(units.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def carry_forward(fresh: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Decisions of before for units that weren't looked at again."""
    before = old.select(*key, F.col("bucket").alias("_old"))
    return fresh.join(before, key, "left").withColumn("bucket", F.when(F.col("reviewed"), F.col("bucket")).otherwise(F.coalesce("_old", "bucket"))).drop("_old")


def critic(issues: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Issues but those that a verdict calls invalid; a missing or malformed verdict keeps its issue."""
    return issues.join(verdicts.filter("verdict = 'invalid'").select(*key), key, "left_anti")


def decode_decision(answer: Column) -> Column:
    """The decision in a model's JSON answer, nulls left out: checked values, or the safe default with ok = false."""
    got = F.from_json(drop_nulls(answer), "bucket STRING, change_kind STRING, confidence DOUBLE, reason STRING, risk_signals ARRAY<STRING>")
    ok = got["bucket"].isin(_NAMES) & got["confidence"].between(0, 1) & (F.length(F.trim(got["reason"])) > 0) & got["change_kind"].isin(list(KIND_WEIGHTS))
    ok = F.coalesce(ok, F.lit(False))
    pick = lambda c, default: F.when(ok, c).otherwise(F.lit(default))
    return F.struct(ok.alias("ok"), pick(got["bucket"], "human").alias("bucket"), pick(got["change_kind"], "behavior").alias("change_kind"), pick(got["confidence"], 0.0).alias("confidence"), pick(got["reason"], "no valid answer").alias("reason"), F.coalesce(got["risk_signals"], F.array().cast("array<string>")).alias("risk_signals"))


def decode_issues(issues: Column) -> Column:
    """struct(issues, checks) of array<struct<severity, title, unseen, preexisting, scenario>>: unknown severities are
    medium; what concerns code that wasn't shown is a check; what was there before or has no scenario is at most low."""

    def one(x: Column) -> Column:
        known = F.when(x["severity"].isin(list(SEVERITY)), x["severity"]).otherwise("medium")
        capped = (F.coalesce(x["preexisting"], F.lit(False)) | (F.length(F.trim(F.coalesce(x["scenario"], F.lit("")))) == 0)) & (severity_weight(known) > SEVERITY["low"])
        return F.struct(F.when(capped, "low").otherwise(known).alias("severity"), x["title"].alias("title"), F.when(capped, known).alias("claimed"))

    seen = F.filter(issues, lambda x: ~F.coalesce(x["unseen"], F.lit(False)))
    rest = F.filter(issues, lambda x: F.coalesce(x["unseen"], F.lit(False)))
    return F.struct(F.transform(seen, one).alias("issues"), F.transform(rest, lambda x: x["title"]).alias("checks"))


def two_models(rows: DataFrame, accept: dict[str, float]) -> DataFrame:
    """rows with bucket, confidence and source: what the first model says where it is sure enough, else the second.

    rows(choice, probabilities: map, first_confidence, changes_behavior?, cut_off, second_bucket?, second_confidence?). The
    first is deferred for an unknown bucket, for less than the bucket's acceptance, for "none" while behavior may change, and for
    a text that was cut unless a person gets it; without an answer of the second, a person decides.
    """
    choice = F.col("choice")
    p = F.coalesce(F.nullif(F.try_element_at("probabilities", choice), F.lit(0.0)), "first_confidence", F.lit(0.0))
    why = (
        F.when(choice.isNull() | ~choice.isin(_NAMES), "invalid answer")
        .when(p < lookup(accept, choice, 0.0), "not sure enough")
        .when((choice == "none") & (F.coalesce("changes_behavior", F.lit(0.0)) > 1 - accept.get("none", 0.0)), "behavior may change")
        .when(F.col("cut_off") & (choice != "human"), "text was cut")
    )
    sure = why.isNull()
    return rows.withColumns({
        "bucket": F.when(sure, choice).otherwise(F.coalesce("second_bucket", F.lit("human"))),
        "confidence": F.when(sure, p).otherwise(F.coalesce("second_confidence", F.lit(0.0))),
        "source": F.when(sure, "first").when(F.col("second_bucket").isNotNull(), "second").otherwise("none"),
        "deferred": why,
    })


def rescore(units: DataFrame) -> DataFrame:
    """units of older runs, which lack a score: prior, pin and floor are made from the stored bucket, a failed summary pins to
    a person, and a reviewed unit gets what its review gives; scored units and those without a bucket stay.

    units(prior?, base?, pin?, floor?, attention, clean, bucket, escalated: array, reviewed, review_failed, severities, and what
    score_units takes).
    """
    old = F.col("prior").isNull() & F.col("bucket").isNotNull()
    keep = ["prior", "base", "pin", "floor", "attention", "clean"]
    named = units.withColumn("_old", old).withColumns({f"_{c}": F.col(c) for c in keep}).drop(*keep)
    made = score_units(named)
    failed = F.exists("escalated", lambda x: x.startswith("summarizer:") | x.startswith("summary failed:"))
    made = made.withColumn("pin", F.when(failed, "human").otherwise(F.col("pin")))
    seen = after_review(made.withColumn("_first_pin", F.col("pin")))
    unseen = {"attention": F.lit(0), "clean": F.lit(0.0), "pin": F.col("_first_pin")}
    seen = seen.withColumns({c: F.when(F.col("reviewed"), F.col(c)).otherwise(v) for c, v in unseen.items()})
    return seen.withColumns({c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")) for c in keep}).select(*units.columns)
