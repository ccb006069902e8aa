"""Change logs: delimited records of commits as rows, and their reference texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators.windows import topk_per_group

#: Control characters between records and between the fields of a record's head.
RECORD, FIELD = "\x1e", "\x1f"


def read_log(spark: SparkSession, path: str, repo: Column | None = None) -> DataFrame:
    """Commits of log files: records of four fields (hash, epoch seconds, email, subject), then lines of status and path.

    Spark splits the files at the record mark, so a large log is read by many tasks.
    """
    lines = spark.read.option("lineSep", RECORD).text(path).withColumn("seq", F.monotonically_increasing_id())
    return parse_log(lines, "value").withColumn("repo", F.lit("") if repo is None else repo)


def write_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Keeps rows(repo, text), whole records, as files by repo and day of the commit, which is what ``scan_log`` prunes by.

    Records without a time have the day of 1970-01-01. Files are text between record marks, as the logs were."""
    when = F.try_element_at(F.split(F.element_at(F.split("text", "\n"), 1), FIELD), F.lit(2)).try_cast("bigint")
    dated = rows.select("repo", F.to_date(F.timestamp_seconds(F.coalesce(when, F.lit(0)))).alias("day"), F.col("text").alias("value"))
    dated.repartition("repo", "day").write.partitionBy("repo", "day").option("lineSep", RECORD).mode(mode).text(path)


def scan_log(spark: SparkSession, path: str, since: datetime | None = None, repos: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Commits of ``write_log``'s files from since on, of the repos; of each repo the newest ``limit``.

    Both bounds are filters on the folders' columns: files of other days and repos are never opened. A limit keeps so many rows a repo
    in each task before the shuffle.
    """
    files = spark.read.schema("value string, repo string, day date").option("lineSep", RECORD).text(path)
    files = files if since is None else files.filter(F.col("day") >= F.lit(since.date()))
    files = files if repos is None else files.filter(F.col("repo").isin(repos))
    rows = parse_log(files.withColumn("seq", F.monotonically_increasing_id()), "value", "repo")
    rows = rows if since is None else rows.filter(F.col("ts") >= F.lit(since.replace(tzinfo=None)).cast("timestamp_ntz"))
    return rows if limit is None else topk_per_group(rows, ["repo"], [F.desc("ts"), F.asc("hash")], limit, "_rk").drop("_rk")


def parse_log(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(hash, ts, email, subject, seq, files) of records; short ones are dropped, emails are lower-cased."""
    head = F.split(F.element_at(F.split(text, "\n"), 1), FIELD)
    body = F.filter(F.split(F.col(text), "\n"), lambda _, i: i > 0)
    kept = F.filter(F.transform(body, lambda x: F.split(x, "\t")), lambda x: F.size(x) >= 2)
    files = F.transform(kept, lambda x: F.struct(F.substring(x[0], 1, 1).alias("status"), F.element_at(x, -1).alias("path")))
    good = rows.filter(F.size(head) == 4)
    ts = F.timestamp_seconds(F.try_element_at(head, F.lit(2)).try_cast("bigint")).cast("timestamp_ntz")
    return good.select(F.trim(head[0]).alias("hash"), ts.alias("ts"), F.lower(head[2]).alias("email"), head[3].alias("subject"), "seq", files.alias("files"), *keep).filter("ts IS NOT NULL")


def parse_target(text: Column) -> Column:
    """struct(repo, path, sym, lo, hi) of 'repo/path', 'repo/path:Sym', 'repo/path:12' or 'repo/path:12-15'."""
    plain = F.regexp_replace(text, r"^code/", "")
    tail = F.regexp_extract(plain, r":([^:/]*)$", 1)
    place = F.regexp_replace(plain, r":[^:/]*$", "")
    lines = tail.rlike(r"^\d+(-\d+)?$")
    lo = F.when(lines, F.regexp_extract(tail, r"^(\d+)", 1).cast("int"))
    hi = F.when(lines, F.coalesce(F.nullif(F.regexp_extract(tail, r"-(\d+)$", 1), F.lit("")).cast("int"), lo))
    return F.struct(F.substring_index(place, "/", 1).alias("repo"), F.regexp_replace(place, r"^[^/]*/?", "").alias("path"), F.when(~lines & (tail != ""), tail).alias("sym"), lo.alias("lo"), hi.alias("hi"))
