"""Joins: intervals, innermost, fallback by levels, prefixes, best matches, rules, ordered probes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.patterns import map_glob

#: A table with at most so many rows is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has at most so many rows (which is counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs of rows with the same key whose closed ranges overlap; the ranges' columns must have different names.

    With a width, ranges are dealt to bins of it and pairs meet in the first bin they share, so that a key with very
    many ranges is spread over bins.
    """
    (a1, a2), (b1, b2) = a_range, b_range
    meets = (F.col(a1) <= F.col(b2)) & (F.col(b1) <= F.col(a2))
    if width is None:
        return a.join(b, on).filter(meets)
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left, right = a.withColumn("_bin", bins(a1, a2)), b.withColumn("_bin", bins(b1, b2))
    first = F.floor(F.greatest(a1, b1) / width) == F.col("_bin")
    return left.join(right, [*on, "_bin"]).filter(meets & first).drop("_bin")


def innermost(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, name: str, order: str) -> DataFrame:
    """points with the name of the shortest range that holds the point (the first in order of equals), or null."""
    held = points.join(ranges, on).filter((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end)))
    keys = {c: f"_{c}" for c in points.columns}
    best = held.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(F.min_by(name, F.struct(F.col(end) - F.col(start), F.col(order))).alias("_best"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return points.distinct().join(best, same, "left").select(*points.columns, F.col("_best").alias(name))


def longest_prefix(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """paths with the longest prefix that ends where one of their parts ends, or null: an equi-join on ancestors."""
    from changeloom.functions.scalars import ancestors

    spread = paths.select(path).distinct().withColumn("_at", F.explode(ancestors(F.col(path), itself=True)))
    found = spread.join(prefixes.select(F.col(prefix).alias("_at")).distinct(), "_at").groupBy(path).agg(F.max_by("_at", F.length("_at")).alias(prefix))
    return paths.join(found, path, "left")


def best_match(left: DataFrame, right: DataFrame, on: list[str], score: Column, key: list[str]) -> DataFrame:
    """All pairs tied at a left row's highest positive score."""
    pairs = left.join(right, on).withColumn("score", score).filter("score > 0")
    most = pairs.groupBy(*key).agg(F.max("score").alias("_most"))
    return pairs.join(most, key).filter("score = _most").drop("_most")


def match_rules(subjects: DataFrame, rules: list[dict], path: str = "path") -> DataFrame:
    """A row for each rule that a subject meets: its columns, rule_id, rule_score, rule_cap, rule_floor.

    A rule has an id, a score, perhaps cap and floor, and conditions: globs ``path`` (any) and ``not_path`` (none), and
    lists of values for other columns; of symbols also ``tags`` (any), expressions ``sym`` (any) and ``exported``. Rules are code, so each becomes literal patterns that are compiled once.
    """

    def holds(rule: dict) -> Column:
        out = F.lit(True)
        for column, want in rule.items():
            if column in ("id", "score", "cap", "floor"):
                continue
            if column in ("path", "not_path"):
                any_of = F.lit(False)
                for g in want:
                    any_of = any_of | F.col(path).rlike(map_glob(g))
                out = out & (any_of if column == "path" else ~any_of)
            elif column == "tags":
                out = out & F.arrays_overlap("tags", F.array(*map(F.lit, want)))
            elif column == "sym":
                out = out & reduce(or_, [F.col("sym").rlike(x) for x in want])
            elif column == "exported":
                out = out & (F.col("exported") == want)
            else:
                out = out & F.col(column).isin(want)
        return out

    if not rules:
        return subjects.filter(F.lit(False)).select("*", F.lit("").alias("rule_id"), F.lit(0).alias("rule_score"), F.lit(None).cast("int").alias("rule_cap"), F.lit(0).alias("rule_floor"))
    made = [F.when(holds(r), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["score"]).alias("rule_score"), F.lit(r.get("cap")).cast("int").alias("rule_cap"), F.lit(r.get("floor", 0)).alias("rule_floor"))) for r in rules]
    return subjects.withColumn("_rule", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull()))).select(*subjects.columns, "_rule.*")


def first_existing(candidates: DataFrame, key: list[str], array: str, known: DataFrame, name: str) -> DataFrame:
    """For each row's list of candidates, the first that is known, or null."""
    spread = candidates.select(*key, F.posexplode(array).alias("_pos", name))
    found = spread.join(known.select(name).distinct(), name).groupBy(*key).agg(F.min_by(name, "_pos").alias(name))
    return candidates.join(found, key, "left")


def fallback(queries: DataFrame, key: str, levels: list[tuple[str, DataFrame]], depth: str = "depth") -> DataFrame:
    """The rows of the first level that has any for a query, of the same level those of the greatest depth.

    levels: (name, rows with the query's key, a depth and what is looked up). Queries without rows get the level 'none'.
    """
    every = None
    for i, (name, rows) in enumerate(levels):
        own = rows.withColumn("_order", F.lit(i)).withColumn("matched", F.lit(name))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    best = every.groupBy(key).agg(F.min(F.struct("_order", (-F.col(depth)).alias("_depth"))).alias("_best"))
    kept = every.join(best, key).filter((F.col("_order") == F.col("_best._order")) & (-F.col(depth) == F.col("_best._depth"))).drop("_order", "_best")
    return queries.join(kept, key, "left").withColumn("matched", F.coalesce("matched", F.lit("none")))


def missing(lists: DataFrame, array: str, present: str, out: str = "missing") -> DataFrame:
    """What of one array isn't in another."""
    return lists.withColumn(out, F.array_except(array, present))
