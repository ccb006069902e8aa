"""Reports: maxima and envelopes, counts, statistics of graphs, nested results, lines of text, orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def maxima(units: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """(by, impact_id, impact, likelihood_id, likelihood, attention): the worst units that no rule has skipped; the first
    of equals. units(id, source, bucket, impact?, likelihood?, attention)."""
    some = units.filter(~((F.col("source") == "rule") & (F.col("bucket") == "none")))

    def worst(c: str) -> Column:
        return F.max_by(F.struct("id", c), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col(order))))

    made = some.groupBy(*by).agg(worst("impact").alias("i"), worst("likelihood").alias("l"), F.max("attention").alias("attention"))
    return made.select(*by, F.col("i.id").alias("impact_id"), "i.impact", F.col("l.id").alias("likelihood_id"), "l.likelihood", "attention")


def worst_impact(hunks: DataFrame, by: list[str]) -> DataFrame:
    """The largest impact of a file's hunks(impact?), 0 where none is known, and how many there are."""
    return hunks.groupBy(*by).agg(F.coalesce(F.max("impact"), F.lit(0)).alias("impact"), F.count("*").alias("hunks"))


def old_range(hunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): the lines of the base that hunks(old_start, old_lines) span, from 1 on; a hunk without old lines
    reaches to the line after its place."""
    end = F.when(F.col("old_lines") == 0, F.col("old_start") + 1).otherwise(F.col("old_start") + F.col("old_lines") - 1)
    least = F.min(F.when(F.col("old_start") > 0, F.col("old_start")))
    return hunks.groupBy(*by).agg(F.greatest(F.coalesce(least, F.lit(0)), F.lit(1)).alias("start"), F.greatest(F.max(end), F.lit(1)).alias("end"))


def commentable(lines: DataFrame, changes: DataFrame, on: list[str], within: int = 3) -> DataFrame:
    """lines(on, n) that a comment can be put at: within so many lines of an added one, or of where lines were deleted.

    changes(on, at, deleted): an added line is at its number; a deletion stands before the line ``at``. Each change is
    spread over the lines near it, so that this is an equi-join.
    """
    near = F.when(F.col("deleted"), F.sequence(F.col("at") - within, F.col("at") + within - 1)).otherwise(F.sequence(F.col("at") - within, F.col("at") + within))
    spots = changes.select(*on, F.explode(near).alias("n")).distinct()
    return lines.join(spots, [*on, "n"], "left_semi")


def graph_statistics(nodes: DataFrame, edges: DataFrame, known: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: nodes, stubs (nodes of no file), edges within, edges to what isn't known(key), URLs matched and not.

    nodes(key, file?); edges(src, dst); urls(matched).
    """
    ends = edges.join(known.select(F.col("key").alias("dst")).distinct().withColumn("_in", F.lit(True)), "dst", "left")
    a = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("file", F.lit("")) == "").alias("stubs"))
    b = ends.agg(F.count_if("_in").alias("edges"), F.count_if(F.col("_in").isNull()).alias("external"))
    c = urls.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def human_units(results: DataFrame) -> DataFrame:
    """(repo, results, human): results of a repository and their units for people. results(repo, human?)."""
    return results.groupBy("repo").agg(F.count("*").alias("results"), F.sum(F.coalesce("human", F.lit(0))).alias("human"))


def faithfulness(scores: DataFrame, by: list[str], low: float = 0.5) -> DataFrame:
    """(by, n, mean, low): the mean of a judge's scores(id, score) of summaries, and those below ``low``, the lowest first."""
    bad = F.array_sort(F.collect_list(F.when(F.col("score") < low, F.struct("score", "id"))))
    return scores.filter("score IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.transform(bad, lambda x: x["id"]).alias("low"))


def related(units: DataFrame, by: list[str], order: str = "ord", most: int = 60) -> DataFrame:
    """units with the ids of the first others of their group, at most so many.

    Only the first most + 1 ids of a group are gathered, so that a large group costs a list of that size a row.
    """
    w = Window.partitionBy(*by).orderBy(order)
    first = units.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most + 1)
    ids = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "id"))), lambda x: x["id"]).alias("_ids"))
    return units.join(ids, by).withColumn("related", F.slice(F.filter("_ids", lambda x: x != F.col("id")), 1, most)).drop("_ids")


def chain_ends(chain: Column) -> Column:
    """The first and the last of a chain of more than two."""
    return F.when(F.size(chain) > 2, F.array(F.element_at(chain, 1), F.element_at(chain, -1))).otherwise(chain)


def result_order(number: str = "number", created: str = "created_at") -> list[Column]:
    """The larger number first, then the newer result."""
    return [F.desc(number), F.desc(created)]


def table_order(key: str, down: bool = True, name: str = "id") -> list[Column]:
    """By the chosen column, nulls last, and by name where it ties."""
    return [F.desc_nulls_last(key) if down else F.asc_nulls_last(key), F.asc(name)]


def nested(units: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, files): array<struct<file, units>> by file, and in a file by line and id: the shape of a stored result."""
    inner = units.groupBy(*by, "file").agg(F.array_sort(F.collect_list(F.struct("line", "id", *[c for c in columns if c not in ("line", "id")]))).alias("units"))
    return inner.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("file", "units"))).alias("files"))


def as_json(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, json): each row as a JSON text."""
    return df.select(*key, F.to_json(F.struct(*df.columns)).alias("json"))


#: Sections of the report, in their order.
SECTIONS = {"human": "Needs a person", "skim": "Skim", "none": "No review"}


def markdown(units: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """(by, report): Markdown with a section for each bucket that has units(id, bucket, total, reason, ord)."""
    line = F.format_string("- `%s` (%d) %s", F.col("id"), F.col("total"), F.coalesce("reason", F.lit("")))
    lists = units.groupBy(*by, "bucket").agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("l"), F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("bucket"))
    title = F.element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("bucket"))
    section = F.concat(F.lit("## "), title, F.lit(" ("), F.col("n"), F.lit(")\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    made = lists.withColumn("section", section).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "section"))).alias("s"))
    return made.select(*by, F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("report"))


def eval_lines(rates: DataFrame) -> DataFrame:
    """rates(case, units, exact, misses, under, over) with ``text``: a line of shares for each case, halves rounded to even."""
    share = lambda c: F.format_string("%d (%.1f%%)", F.col(c), F.bround(F.coalesce(F.try_divide(100.0 * F.col(c), F.col("units")), F.lit(0.0)), 1))
    text = F.format_string("%s: %d units, exact %s, misses %s, under %s, over %s", F.col("case"), F.col("units"), *[share(c) for c in ("exact", "misses", "under", "over")])
    return rates.withColumn("text", text)
