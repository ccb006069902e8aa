"""What the text operators share: column picking, batched text functions, cutting lineage, joins on hot keys."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A batch that goes to Python holds at most so many rows or bytes, so that long texts don't fill a worker.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20

#: Functions of single texts get so many bytes at a time: their words as Python objects take ten times as much.
PART_BYTES = 2 << 20

#: A key with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of those.
HOT_SHARE = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name even where others differ in case only or repeat it (the first counts)."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, whose executors are the driver, gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and writes it to the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame, *out: str) -> DataFrame:
    """The named columns, and all others in one struct, so that no column of an operator can clash with them."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    at = [df.columns.index(n) for n in out]
    rest = [c for i, c in enumerate(flat.columns) if i not in at]
    return flat.select(F.struct(*rest, F.lit(0).alias("none")).alias("held"), *[F.col(f"_{i}").alias(n) for i, n in zip(at, out, strict=True)])


def freed(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """What ``held`` put away, in the order of ``columns``; ``made`` has the columns that were named there."""
    firsts = {n: columns.index(n) for n in made}
    return df.select(*[(made[c] if firsts.get(c) == i else F.col(f"held._{i}")).alias(c) for i, c in enumerate(columns)])


_once: dict = {}


def once(key: object, build: Callable[[], object]) -> object:
    """What build() makes, kept in the worker until another key is asked for: a worker holds one large thing."""
    if key not in _once:
        _once.clear()
        _once[key] = build()
    return _once[key]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batch: pa.RecordBatch, at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text, or one row."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if size + (n or 0) > most and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]], fields: list[T.StructField], drop: bool = False) -> DataFrame:
    """df with the columns of ``fields`` (they replace columns of that name), made from whole texts.

    ``make`` runs once in each task and gives the function from a list of UTF-8 texts (None: null) to one Arrow
    array a field. ``drop`` leaves the text column out of the result.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    df = df.select(*[c for c in df.columns if c not in new or c == text])
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in new and not (drop and i == at)]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in slices(whole, at, PART_BYTES):
                made = f(batch.column(at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def join_sizes(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, most: int | None = None) -> DataFrame:
    """Left join of rows with groups (one row a key, with its number of rows), where a few keys may hold most rows.

    Keys with more than one in HOT_SHARE of all rows are fewer than HOT_SHARE, so their groups are broadcast. Rows of
    other keys meet their group in a shuffle, for which rows already served are dealt by ``spread`` instead. ``most``: the sum
    of the sizes or more, if it is known.
    """
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size).alias("_all"))
    large = groups.join(F.broadcast(total), F.col(size) * HOT_SHARE > F.col("_all")) if most is None else groups.filter(F.col(size) * HOT_SHARE > most)
    hot = large.select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    first = rows.join(F.broadcast(hot), key, "left")
    dealt = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.col(spread)))
    met = dealt.join(cold, "_key", "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values])
