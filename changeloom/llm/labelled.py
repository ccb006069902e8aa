"""Labelled rows for the classifiers: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import pick

#: Rows whose crc32(doc_id as text) leaves 0 by this are held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[float]]:
    """(doc_id, y, text) of at most ``most`` rows of each label that may be learned from, and the number of ids of
    label 0 and of 1 there are. The rows are those with the smallest hashes of their ids; where labels repeat an id,
    its largest label counts; where documents repeat it, the text with the smallest hash; null labels don't count.
    """
    known = pick(labels, doc_id, label).filter(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg((F.max(label) > 0).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    few = [known.filter(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(most) for y in (0, 1)]
    chosen = few[0].unionByName(few[1])
    texts = pick(docs, doc_id, text).join(F.broadcast(chosen), doc_id)
    one = F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")))
    return texts.groupBy(doc_id, "y").agg(one.alias("one")).select(doc_id, "y", F.col("one.text").alias(text)), [float(counts.get(y, 0)) for y in (0, 1)]
