"""Ranking and windows: percentiles, firsts and latests, running numbers, islands, gaps, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.session import cut


def percentile_below(df: DataFrame, value: str, out: str = "percentile", by: list[str] | None = None, include: Column | None = None, tolerance: float = 1e-9) -> DataFrame:
    """100 times the share of the population (the rows of ``include``) with a value below v by more than tolerance * |v|.

    The tolerance keeps sums of the same numbers in another order from parting ties. Each distinct value is two events on one
    line: its rows count from the value on, and its own question stands at its threshold, before values there. One
    running count over the line answers all questions: a range shuffle and one number a task, or a window a group.
    """
    by = by or []
    keep = F.lit(True) if include is None else F.coalesce(include, F.lit(False))
    rows = df.withColumn("_v", F.when(keep, F.col(value).cast("double")))
    counts = rows.filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    events = F.array(F.struct(event(F.col("_v"), 1).alias("_at"), F.col("_n").alias("_c")), F.struct(event(F.when(F.col("_v") < 0, F.col("_v") * (1 + tolerance)).otherwise(F.col("_v") * (1 - tolerance)), 0).alias("_at"), F.lit(0).cast("bigint").alias("_c")))
    line = counts.select(*by, "_v", F.explode(events).alias("_e")).select(*by, "_v", "_e.*")
    if by:
        w = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        summed = line.withColumn("_below", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    else:
        summed = running_total(line, "_at", "_c", "_below").crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
    below = summed.filter("_at.kind = 0").select(*by, "_v", "_below", "_all")
    met = rows.join(below, [*by, "_v"], "left")
    return met.withColumn(out, 100.0 * F.col("_below") / F.col("_all")).select(*df.columns, out)


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The sum of ``value`` over rows with a smaller ``order``, without one task for all rows: rows are range-dealt, sums
    of the parts are added up (a row a part), then each part adds its own. What was dealt is written once, so that both
    readings see the same bounds."""
    dealt = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_from"))
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + own).drop("_part", "_before")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first. Rows are folded in each task before the shuffle."""
    return _folded(df, keys, F.min_by, order)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _folded(df, keys, F.max_by, order)


def _folded(df: DataFrame, keys: list[str], pick, order: list[Column]) -> DataFrame:
    row = F.struct(*df.columns)
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """The first k rows of each group with their number. Spark keeps k rows a group in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def islands(df: DataFrame, by: list[str], order: list[Column], value: str, out: str = "island") -> DataFrame:
    """Numbers, from 1, runs of rows with one value; rows without a value stay in the run that they stand in."""
    w = Window.partitionBy(*by).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("_held", F.last(value, ignorenulls=True).over(past))
    new = (F.col("_held").isNotNull() & ~F.col("_held").eqNullSafe(F.lag("_held").over(w)) & F.lag("_held").over(w).isNotNull()).cast("int")
    return held.withColumn("_new", new).withColumn(out, (1 + F.sum("_new").over(past)).cast("int")).drop("_held", "_new")


def running_numbers(df: DataFrame, by: list[str], order: list[Column], counts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each new column (start, step): start plus the steps of the rows before this one."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: start + F.coalesce(F.sum(step).over(past), F.lit(0)) for name, (start, step) in counts.items()})


def insert_points(df: DataFrame, by: list[str], order: list[Column], op: str, out: str = "inserts") -> DataFrame:
    """Whether an added line stands in a run of added lines with no removed line before it."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(op).isin(" ", "-"), F.col(op)), ignorenulls=True).over(past)
    return df.withColumn(out, (F.col(op) == "+") & F.coalesce(before == " ", F.lit(True)))


def span_end(by: list[str], order: list[Column], start: str, last: Column) -> Column:
    """Where a span ends if the next begins after it; the last one ends at ``last``."""
    return F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(*order)) - 1, last)


def gap_before(by: list[str], order: list[Column], start: str, end: str) -> Column:
    """What lies between a span and the one before it."""
    return F.col(start) - F.lag(end).over(Window.partitionBy(*by).orderBy(*order))
