"""Maps of records: ordered JSON shards of repositories, published by a manifest that is written last.

A write goes to a folder of its own (``data/seq=N``); its manifest (``manifest/seq=N``, one file, a row for each repository) makes
it visible. Readers follow the manifests, so a write that fails leaves the map as it was, and one that runs sees no half of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.schemas import MAP_RECORD

#: Order of records of one path.
LEVEL_ORDER = ["dir", "file", "symbol", "repo"]

_MANIFEST = "repo STRING, records BIGINT, removed BOOLEAN, seq INT"


def map_order() -> list[Column]:
    """Repository, path, level, first line, id."""
    rank = F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), F.col("level"))
    return [F.col("repo"), F.col("path"), rank, F.try_element_at("lines", F.lit(1)), F.col("id")]


def _folder(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The table kept in a folder by seq, which is made empty if it isn't there."""
    spark.createDataFrame([], schema).write.partitionBy("seq").mode("ignore").json(f"{path}/{name}")
    return spark.read.schema(schema).json(f"{path}/{name}")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, records): of each repository the write that counts, which is its newest published one."""
    newest = _folder(spark, path, "manifest", _MANIFEST).groupBy("repo").agg(F.max_by(F.struct("seq", "records", "removed"), "seq").alias("m"))
    return newest.filter("NOT m.removed").select("repo", "m.seq", "m.records")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, file): all files of records, published or not, by their names alone."""
    _folder(spark, path, "data", f"{MAP_RECORD}, seq INT")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.col("path").alias("file"))
    part = lambda name: F.url_decode(F.replace(F.regexp_extract("file", f"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return found.filter(F.col("file").contains("/repo=")).select(part("repo").alias("repo"), part("seq").cast("int").alias("seq"), "file")


def stale(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, file) of shards that no reader follows: replaced, of removed repositories, or of writes that failed. They may be
    deleted once no reader began before the newest manifest and no write is on its way."""
    return shards(spark, path).join(live(spark, path).select("repo", "seq"), ["repo", "seq"], "left_anti")


def write_map(records: DataFrame, path: str, removed: DataFrame | None = None, parts: int | None = None) -> int:
    """Publishes records in place of what their repositories had; removed(repo): repositories that are gone. The write's number.

    Records are range-dealt in the map's order, so a large repository is many tasks' work, and the files of a repository in the
    order of their names are its records in order. A number that was begun is never used again; of two writers at once the one
    that comes second to its folder fails.
    """
    spark = records.sparkSession
    begun = shards(spark, path).select("seq").unionByName(_folder(spark, path, "manifest", _MANIFEST).select("seq"))
    seq = (begun.agg(F.max("seq")).first()[0] or 0) + 1
    order = map_order()
    dealt = records.repartitionByRange(*order) if parts is None else records.repartitionByRange(parts, *order)
    dealt.sortWithinPartitions(*order).write.partitionBy("repo").mode("error").json(f"{path}/data/seq={seq}")
    wrote = spark.read.schema(MAP_RECORD).json(f"{path}/data/seq={seq}").groupBy("repo").agg(F.count("*").alias("records")).withColumn("removed", F.lit(False))
    if removed is not None:
        gone = removed.select("repo").distinct().join(wrote.select("repo"), "repo", "left_anti")
        wrote = wrote.unionByName(gone.select("repo", F.lit(0).cast("bigint").alias("records"), F.lit(True).alias("removed")))
    wrote.coalesce(1).write.mode("error").json(f"{path}/manifest/seq={seq}")
    return seq


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The published records. Filters on repo read only its folders."""
    rows = _folder(spark, path, "data", f"{MAP_RECORD}, seq INT")
    return rows.join(live(spark, path).select("repo", "seq"), ["repo", "seq"], "left_semi").drop("seq")


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("level").count()
