"""A corpus pipeline in stages: each works on all that the one before kept, and its decisions take effect.

Documents that the toxicity classifier rejects go; frequent lines go; of each group of near-duplicates the document with
the smallest id stays; documents that hold a passage of the benchmark go; what is left is encoded, and decoded again
to prove it. Stages pass on the columns of documents, with n_chars as the text then is.

Cases: rows that repeat an id count as one document from the third stage on, the one with the smallest hash of its text; a null
id can't name a group's document, so its rows pass that stage; null texts stay null until they are encoded as empty; very
long texts are worked on whole; further columns are passed on as they are, whatever their names, up to the last stage; an
empty table passes all stages as an empty table.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import bpe, decontaminate, line_dedup, similar, toxicity
from changeloom.llm.common import freed, held, pick, shared_folder, table

#: A document with this probability of being toxic is rejected.
REJECT = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cases: null and empty texts have the score of a text of no known n-gram; without labels of both kinds all documents
    have the share of toxic labels as their score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return freed(toxicity.score(held(docs, "text"), model).filter(F.col("score") < REJECT), docs.columns, text=F.col("text"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cases: a document that loses all its lines stays, with an empty text; a null text stays null."""
    left = line_dedup.line_dedup(held(docs, "text", "n_chars"))
    return freed(left, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("bigint"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cases: texts without words are alike; rows with a null id stay."""
    rows = held(docs, "doc_id", "text")
    stay = similar.near_copies(pick(docs, "doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    known = rows.filter("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi")
    one = known.groupBy("doc_id").agg(F.min_by(F.struct("held", "text"), F.struct(F.xxhash64("text"), "text")).alias("one")).select("doc_id", "one.*")
    return freed(one.unionByName(rows.filter("doc_id IS NULL")), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cases: texts without words aren't contaminated; an empty benchmark drops nothing."""
    found = decontaminate.marked(held(docs, "text"), table(spark, sf_dir, "benchmark"))
    return freed(found.filter(F.size("hit_words") == 0), docs.columns, text=F.col("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, how many they are, and whether they decode to its bytes.

    Cases: a null text has no ids, which decode to no bytes; other columns aren't passed on."""
    made = bpe.decode(bpe.encode(pick(docs, "doc_id", "lang", "source", "text")))
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_frequent_lines),
    ("simhash", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the folder that executors share, and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
