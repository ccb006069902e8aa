"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

Texts are equal when they are identical after A-Z are lower-cased. Only DataFrame functions run here.

Cases: a null text counts as empty; empty texts are equal to each other; a null doc_id is smaller than any other, and
a group of null doc_ids only keeps all its rows; rows that repeat a doc_id share its fate; an empty input gives an
empty result; a very long text is one digest like any other; further columns are ignored; a batch that an index has
already isn't added again.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import LOWER, UPPER, cut, join_sizes, pick

SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"

#: The report adds its documents in so many batches, dealt by a hash of their ids.
BATCHES = 2


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, 32 bytes."""
    normal = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return pick(docs, doc_id, text).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


class DigestIndex:
    """Digests in a table, one row each: digest, the largest id and the number of rows that had it in the batch that brought it.

    The table is bucketed and sorted by digest. A batch is joined to it by a sort-merge anti-join, for which only the batch is
    shuffled; what that leaves is new and is appended, so no digest is ever there twice. What a batch changes for known digests, a
    larger id and more rows, goes to a second table in the same buckets, which readers merge in without a shuffle.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.changes = spark, name, f"{name}_changes"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for table in (self.name, self.changes):
            if not spark.catalog.tableExists(table):
                self._write(spark.createDataFrame([], SCHEMA), table, "errorifexists")

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        df.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode(mode).saveAsTable(table)

    def rows(self) -> DataFrame:
        """A row for each digest, with the largest id and the number of rows of all batches."""
        more = self.spark.table(self.changes).groupBy("digest").agg(F.max("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
        met = self.spark.table(self.name).join(more.hint("merge"), "digest", "left")
        return met.select("digest", F.greatest("keep_id", "_keep").alias("keep_id"), (F.col("group_size") + F.coalesce("_size", F.lit(0))).alias("group_size"))

    def append(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> None:
        self.append_digests(digests(docs, doc_id, text), batch)

    def append_digests(self, rows: DataFrame, batch: str) -> None:
        """Adds rows(doc_id, digest). Each table is written once; if the job is lost between or in the writes, it can be run
        again: what a batch has written already isn't written twice, and its own digests don't count as known to it."""
        groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        known = self.spark.table(self.name).filter(F.col("batch") != batch).select("digest").hint("merge")
        for table, kind in ((self.changes, "left_semi"), (self.name, "left_anti")):
            if self.spark.table(table).filter(F.col("batch") == batch).isEmpty():
                self._write(groups.join(known, "digest", kind).withColumn("batch", F.lit(batch)), table, "append")

    def decide(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        return self.decide_digests(digests(docs, doc_id, text))

    def decide_digests(self, rows: DataFrame) -> DataFrame:
        """A row for each of rows(doc_id, digest), which the index must hold: which id stays for its text, and whether it is this one."""
        spread = F.unhex(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256))
        met = join_sizes(rows.withColumn("_spread", spread), self.rows(), "digest", "group_size", "_spread")
        return met.select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def drop(self) -> None:
        for table in (self.name, self.changes):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def batch_of(batches: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % batches, F.lit(0))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs against themselves, added to an index of their own in batches; the index goes when all is decided."""
    rows = cut(digests(docs, doc_id, text))
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid4().hex}")
    for k in range(batches):
        index.append_digests(rows.filter(batch_of(batches) == k), f"batch {k}")
    out = cut(index.decide_digests(rows))
    index.drop()
    return out
