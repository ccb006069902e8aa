"""Hierarchies of paths: roll-ups to all ancestors, nearest-rank percentiles, inheritance, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors, basename, dirname


def nearest_rank(value: str, q: float) -> Column:
    """The value at place ceil(q * n) of the sorted ones; 0 of none."""
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})"), F.lit(0))


def rollup_paths(files: DataFrame, path: str, aggs: list[Column], by: list[str] | None = None, root: bool = False) -> DataFrame:
    """A row for each directory that holds a file: the aggregates of all files below. One shuffle, because sums, extremes
    and percentiles of the files themselves don't need the levels between. ``root``: the empty path holds all."""
    above = ancestors(F.col(path))
    if root:
        above = F.concat(F.array(F.lit("")), above)
    return files.withColumn("_dir", F.explode(above)).groupBy(*(by or []), F.col("_dir").alias("dir")).agg(*aggs)


def rank_from_children(dirs: DataFrame, path: str = "dir", rank: str = "rank") -> DataFrame:
    """Ranks of directories without one: the highest of the nearest ranked directories below them.

    A directory's rank is that of its children, and an unranked child has that of its own; so the highest ranked
    directory with no ranked one between is looked for, by joining each ranked one to the ancestors up to the next.
    """
    ranked = dirs.filter(F.col(rank).isNotNull())
    up = ranked.select(F.col(path).alias("_of"), F.col(rank).alias("_rank"), F.explode(ancestors(F.col(path))).alias("_at"))
    stops = up.join(ranked.select(F.col(path).alias("_at")), "_at").groupBy("_of").agg(F.max(F.length("_at")).alias("_stop"))
    free = up.join(stops, "_of", "left").filter(F.length("_at") > F.coalesce("_stop", F.lit(-1)))
    best = free.groupBy(F.col("_at").alias(path)).agg(F.max("_rank").alias("_best"))
    out = dirs.join(best, path, "left")
    source = F.when(F.col(rank).isNotNull(), "graph").when(F.col("_best").isNotNull(), "children")
    return out.select(*[F.coalesce(rank, "_best").alias(rank) if c == rank else F.col(c) for c in dirs.columns], source.alias("rank_source"))


def inherit_nearest(files: DataFrame, dirs: DataFrame, path: str = "path", dir_: str = "dir", value: str = "rank") -> DataFrame:
    """files with the value of the nearest directory above that has one, and which it is."""
    spread = files.select(F.col(path).alias("_p"), F.explode(ancestors(F.col(path))).alias("_at")).distinct()
    own = dirs.filter(F.col(value).isNotNull()).select(F.col(dir_).alias("_at"), F.col(value).alias("_v"))
    best = spread.join(own, "_at").groupBy("_p").agg(F.max_by(F.struct("_at", "_v"), F.length("_at")).alias("_b"))
    return files.join(best, F.col(path) == F.col("_p"), "left").select(*files.columns, F.col("_b._v").alias(value), F.concat(F.lit("inherited:"), F.col("_b._at")).alias("rank_source"))


def tree(records: DataFrame, path: str, measures: list[Column]) -> DataFrame:
    """A row for each directory and file: id, parent, name, kind and the measures summed over what is below."""
    dirs = rollup_paths(records, path, measures, root=True).select(F.col("dir").alias("id"), "*").drop("dir").withColumn("kind", F.lit("dir"))
    files = records.groupBy(F.col(path).alias("id")).agg(*measures).withColumn("kind", F.lit("file"))
    both = dirs.unionByName(files)
    parent = F.when(F.col("id") != "", dirname(F.col("id")))
    return both.withColumn("parent", parent).withColumn("name", basename(F.col("id")))


def merge_tags(tags: DataFrame, subject: list[str]) -> DataFrame:
    """The highest score of each tag of a subject, with its way there."""
    return tags.groupBy(*subject, "tag").agg(F.max(F.struct("score", "via")).alias("_b")).select(*subject, "tag", "_b.*")


def rollback_score(tags: DataFrame, subject: list[str], default: int = 10, bonus: int = 3, least: int = 40) -> DataFrame:
    """The strongest tag (or the default), a bonus for each further tag of at least ``least``, at most 100."""
    strongest = F.max("score")
    more = F.greatest(F.lit(0), F.count_if(F.col("score") >= least) - (strongest >= least).cast("int"))
    return tags.groupBy(*subject).agg(F.least(F.lit(100), F.greatest(F.lit(default), strongest) + bonus * more).cast("int").alias("rollback"))


def sorted_tags(tags: DataFrame, subject: list[str]) -> DataFrame:
    """(subject, tags): array<struct<tag, score>> of the highest score of each tag, the highest first, then by name."""
    best = tags.groupBy(*subject, "tag").agg(F.max("score").alias("score"))
    listed = best.groupBy(*subject).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "tag", "score"))).alias("t"))
    return listed.select(*subject, F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"))).alias("tags"))


def file_tags(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, file, tag, score, floor): tags and floors of all of a file's symbols, emitted or not; caps aren't passed on.

    tags(key, tag, score, floor); nodes(key, repo, file, internal): internal ones and those without a file don't count.
    """
    own = nodes.filter(~F.col("internal") & (F.col("file") != "")).select("key", "repo", "file")
    return tags.join(own, "key").groupBy("repo", "file", "tag").agg(F.max("score").alias("score"), F.max("floor").alias("floor"))


def emitted(symbols: DataFrame, least_callers: int = 2, least_score: int = 60, exported: bool = False) -> DataFrame:
    """The symbols(kind, exported, caller_files, top_score, virtual_caller) that get a record of their own."""
    some = (F.coalesce("caller_files", F.lit(0)) >= least_callers) | (F.coalesce("top_score", F.lit(0)) >= least_score)
    some = some | (F.col("kind") == "api-op") | F.coalesce("virtual_caller", F.lit(False))
    return symbols.filter(some | F.col("exported") if exported else some)
