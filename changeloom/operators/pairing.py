"""Pairs of units that share enough tokens, by an inverted index: no pair without a shared posting is ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token(text: Column) -> Column:
    """A token of 16 bytes for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def token_sets(postings: DataFrame, unit: str, tok: str, scope: list[str]) -> DataFrame:
    """(*scope, unit, toks): each unit's tokens that another unit of the scope has too, the rarest first.

    A token of one unit can make no pair, so what is alone goes before anything is gathered.
    """
    own = postings.select(*scope, F.col(unit).alias("unit"), F.col(tok).alias("tok")).distinct()
    often = own.groupBy(*scope, "tok").agg(F.count("*").alias("df")).filter("df > 1")
    sets = own.join(often, [*scope, "tok"]).groupBy(*scope, "unit").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("both"))
    return sets.select(*scope, "unit", F.col("both.tok").alias("toks"))


def alike(sets: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units with the same tokens are one class, named by the least of them: (*scope, unit, rep) of all units, and the sets of reps
    (*scope, rep, toks, copies)."""
    keyed = sets.withColumn("key", F.sha2(F.array_join(F.transform("toks", F.hex), ""), 256))
    classes = keyed.groupBy(*scope, "key").agg(F.min("unit").alias("rep"), F.count("*").alias("copies"))
    met = keyed.join(classes, [*scope, "key"])
    return met.select(*scope, "unit", "rep"), met.filter(F.col("unit") == F.col("rep")).select(*scope, "rep", "toks", "copies")


def sharing(left: DataFrame, right: DataFrame, scope: list[str], least: int, ordered: bool = False) -> DataFrame:
    """(*scope, a, b, shared): a of left(*scope, unit, toks), b of right, with at least so many tokens in common.

    Tokens must come in one order for all units, the rarest first. Two sets that share ``least`` tokens share one besides
    the last ``least - 1`` of either set, so only that prefix is posted: a frequent token makes pairs only of units that have
    hardly any other. Each pair found is then counted on its sets. ``ordered``: a < b, for a table against itself.
    """
    prefix = lambda df, name: df.filter(F.size("toks") >= least).select(*scope, F.col("unit").alias(name), F.explode(F.slice("toks", F.lit(1), F.size("toks") - (least - 1))).alias("tok"))
    met = prefix(left, "a").join(prefix(right, "b"), [*scope, "tok"])
    found = met.filter("a < b" if ordered else "a <> b").select(*scope, "a", "b").distinct()
    with_a = found.join(left.select(*scope, F.col("unit").alias("a"), F.col("toks").alias("of_a")), [*scope, "a"])
    both = with_a.join(right.select(*scope, F.col("unit").alias("b"), F.col("toks").alias("of_b")), [*scope, "b"])
    return both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b"))).filter(F.col("shared") >= least).select(*scope, "a", "b", "shared")


def shared_pairs(postings: DataFrame, unit: str, tok: str, least: int, scope: list[str] | None = None) -> DataFrame:
    """(*scope, a, b, shared, copies_a, copies_b): pairs of classes of units (see ``alike``) that share at least so many tokens of
    postings(*scope, unit, tok). Units of one class share all their tokens, and aren't expanded into pairs."""
    scope = scope or []
    _, reps = alike(token_sets(postings, unit, tok, scope), scope)
    sets = reps.select(*scope, F.col("rep").alias("unit"), "toks")
    pairs = sharing(sets, sets, scope, least, ordered=True)
    size = lambda name: reps.select(*scope, F.col("rep").alias(name), F.col("copies").alias(f"copies_{name}"))
    return pairs.join(size("a"), [*scope, "a"]).join(size("b"), [*scope, "b"]).select(*scope, "a", "b", "shared", "copies_a", "copies_b")
