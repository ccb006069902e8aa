"""Evaluation of decisions: confusion matrix, rates, recall and precision of findings, what-if by budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators.decisions import rank_of, severity_weight


def with_labels(predictions: DataFrame, labels: DataFrame, case: str = "case") -> DataFrame:
    """predictions(case, id, file, bucket) with the label of the unit, else of its file."""
    own = labels.select(case, F.col("key").alias("id"), F.col("bucket").alias("_unit"))
    file = labels.select(case, F.col("key").alias("file"), F.col("bucket").alias("_file"))
    return predictions.join(own, [case, "id"], "left").join(file, [case, "file"], "left").withColumn("label", F.coalesce("_unit", "_file")).drop("_unit", "_file")


def confusion(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows by label, columns by prediction."""
    return labelled.filter("label IS NOT NULL").groupBy(*(by or []), "label").pivot("bucket", ["human", "skim", "none"]).count().na.fill(0, ["human", "skim", "none"])


def rates(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """units, exact, misses (a human's unit skipped), under and over."""
    given, said = rank_of(F.col("bucket")), rank_of(F.col("label"))
    return labelled.filter("label IS NOT NULL").groupBy(*(by or [])).agg(
        F.count("*").alias("units"),
        F.count_if(given == said).alias("exact"),
        F.count_if((said == 2) & (given == 0)).alias("misses"),
        F.count_if(given < said).alias("under"),
        F.count_if(given > said).alias("over"),
    )


def findings(rules: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules(case, rule_id, key, kind, match, min_severity?, max_severity?) against issues(case, issue_id, unit_id, file,
    severity, title): (per rule: found, wrong severity or missed; per issue: true or false positive or unlabelled).

    A rule is for a unit or a file: two equi-joins, not one with an OR.
    """
    by_unit = issues.join(rules.withColumnRenamed("key", "unit_id"), ["case", "unit_id"])
    by_file = issues.join(rules.withColumnRenamed("key", "file"), ["case", "file"])
    columns = ["case", "issue_id", "rule_id", "kind", "match", "min_severity", "max_severity", "severity", "title"]
    pairs = by_unit.select(*columns).unionByName(by_file.select(*columns)).distinct()
    meets = F.expr("lower(title) RLIKE lower(match)")
    w = severity_weight(F.col("severity"))
    within = (F.coalesce(w >= severity_weight(F.col("min_severity")), F.lit(True)) | F.col("min_severity").isNull()) & ((w <= severity_weight(F.col("max_severity"))) | F.col("max_severity").isNull())
    met = pairs.withColumn("_meets", meets).filter("_meets").withColumn("_within", within)
    per = met.groupBy("case", "rule_id").agg(F.bool_or("_within").alias("_right"))
    outcome = F.when(F.col("_right"), "found").when(F.col("_right").isNotNull(), "wrong severity").otherwise("missed")
    by_rule = rules.join(per, ["case", "rule_id"], "left").withColumn("outcome", outcome).select("case", "rule_id", "kind", "outcome")
    kinds = met.groupBy("case", "issue_id").agg(F.bool_or((F.col("kind") == "must_find") & F.col("_within")).alias("_true"), F.bool_or(F.col("kind") == "must_not").alias("_false"))
    verdict = F.when(F.col("_true"), "true positive").when(F.col("_false"), "false positive").otherwise("unlabelled")
    return by_rule, issues.join(kinds, ["case", "issue_id"], "left").select("case", "issue_id", verdict.alias("verdict"))


def precision(verdicts: DataFrame) -> DataFrame:
    tp, fp = F.count_if(F.col("verdict") == "true positive"), F.count_if(F.col("verdict") == "false positive")
    return verdicts.agg(tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, tp + fp).alias("precision"))


def what_if(placed: DataFrame) -> DataFrame:
    """Counts of each budget: buckets, labels placed too low, and issues that would be hidden."""
    given, said = rank_of(F.col("bucket")), rank_of(F.col("label"))
    return placed.groupBy("budget").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("human", "skim", "none")],
        F.count_if(given < said).alias("under"),
        F.sum(F.when(F.col("bucket") == "none", F.col("n_issues")).otherwise(0)).alias("hidden"),
    )
