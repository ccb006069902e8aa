"""Maps as they are published: ordered shards of many tasks, a manifest last, stale shards."""

import pytest
from pyspark.sql import functions as F

from changeloom.schemas import MAP_RECORD
from changeloom.sources import maps


def some(spark, repo, n, impact=1):
    base = spark.range(n).select(F.lit(repo).alias("repo"), F.format_string("f%04d", F.col("id")).alias("path"), F.lit("file").alias("level"), F.lit(impact).alias("impact"), F.format_string("%s/f%04d", F.lit(repo), F.col("id")).alias("id"))
    names = [c.split()[0] for c in MAP_RECORD.replace("STRUCT<tag: STRING, score: INT>", "X").split(", ")]
    return base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string" if c == "sym" else "array<int>" if c == "lines" else "int").alias(c) for c in names if c != "rollback_tags"])


def state(spark, path):
    return {(r["repo"], r["n"], r["impact"]) for r in maps.read_map(spark, path).groupBy("repo").agg(F.count("*").alias("n"), F.max("impact").alias("impact")).collect()}


def test_publication(spark, tmp_path):
    path = f"{tmp_path}/map"
    assert maps.read_map(spark, path).count() == 0  # nothing published yet
    assert maps.write_map(some(spark, "a b+%", 300).unionByName(some(spark, "c", 5)), path, parts=4) == 1
    assert state(spark, path) == {("a b+%", 300, 1), ("c", 5, 1)}
    # one repository is several tasks' work, and its files in order are its records in order
    files = [r["file"] for r in maps.shards(spark, path).filter(F.col("repo") == "a b+%").orderBy("file").collect()]
    assert len(files) >= 3 and maps.stale(spark, path).count() == 0
    listed = [r["id"] for f in files for r in spark.read.json(f).collect()]
    assert listed == sorted(listed) and len(listed) == 300
    # a write that fails half way leaves the old map whole, and its number isn't used again
    broken = some(spark, "c", 200, 2).withColumn("id", F.when(F.col("path") == "f0150", F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        maps.write_map(broken, path, parts=4)
    assert state(spark, path) == {("a b+%", 300, 1), ("c", 5, 1)}
    # records that were written but never published aren't seen either
    some(spark, "c", 9, 8).write.partitionBy("repo").json(f"{path}/data/seq=7")
    assert state(spark, path) == {("a b+%", 300, 1), ("c", 5, 1)} and {(r["repo"], r["seq"]) for r in maps.stale(spark, path).collect()} == {("c", 7)}
    assert maps.write_map(some(spark, "c", 6, 3), path) == 8
    assert state(spark, path) == {("a b+%", 300, 1), ("c", 6, 3)}
    # a repository that is gone
    maps.write_map(some(spark, "d", 1), path, removed=spark.createDataFrame([("a b+%",)], "repo string"))
    assert state(spark, path) == {("c", 6, 3), ("d", 1, 1)}
    assert {(r["repo"], r["seq"]) for r in maps.stale(spark, path).collect()} == {("a b+%", 1), ("c", 1), ("c", 7)}
