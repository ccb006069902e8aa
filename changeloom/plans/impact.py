"""Impact of units by every declaration that they touch: base-side names and the unit's own, looked up together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import basename
from changeloom.operators.joins import overlap_join
from changeloom.plans.lookup import fallback_lookup

#: Files whose declarations have names (the second list in any case), specifications, names of parsed Go units.
NAMED = r"\.(go|ts|tsx|js|jsx|mjs|cjs|java|py|cs|rs)$"
NAMED_IN_ANY_CASE = r"\.(sh|bash|ps1|psm1|c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|ipp|tpp|php|scala|sc|kt|rb|rake|swift|dart)$"
SPECIFICATIONS = ["api.yaml", "openapi.yaml", "api.yml", "openapi.yml", "swagger.yaml"]
GO_NAME = r"^(\(\*?\w+\)\.\w+|\w+|(type|var|const) \w+)$"

#: Lines of a file are dealt to bins of so many, so that a large file with many declarations isn't one group.
BIN = 64


def has_names(path: Column) -> Column:
    spec = basename(path).isin(SPECIFICATIONS) & (path.startswith("api/") | path.contains("/api/"))
    return path.rlike(NAMED) | F.lower(path).rlike(NAMED_IN_ANY_CASE) | spec


def touched(points: DataFrame, declarations: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """(key, names): the innermost declaration that holds each of points(key, on, a, b), in the declarations' order.

    declarations(on, name, start, end, ord); a point is held if both of its lines are, so one between two declarations is in
    neither. Of equal sizes the first in order counts.
    """
    held = overlap_join(points, declarations, on, ("a", "b"), ("start", "end"), BIN).filter("start <= a AND b <= end")
    best = held.groupBy(*key, "a", "b").agg(F.min_by(F.struct("ord", "name"), F.struct(F.col("end") - F.col("start"), "ord")).alias("_d"))
    listed = best.groupBy(*key).agg(F.array_sort(F.collect_set("_d")).alias("_d"))
    return listed.select(*key, F.transform("_d", lambda x: x["name"]).alias("names"))


def resolved(units: DataFrame, base: DataFrame | None) -> DataFrame:
    """units(change_id, id, file, old_path, status, symbol, points, old_lo, old_hi) with path (of the base), syms, lo and hi.

    syms: the unit's own name, then those that its points touch in base(change_id, path, name, start, end, ord). Lines are
    given only for a unit without any name when there is no base; files that can't have names and added ones have none.
    """
    path = F.when((F.col("status") == "renamed") & (F.col("old_path") != ""), F.col("old_path")).otherwise(F.col("file"))
    rows = units.withColumn("path", path).withColumn("_named", has_names(F.col("path")) & (F.col("status") != "added"))
    go = F.col("path").endswith(".go")
    own = F.when(F.col("_named") & ~F.col("symbol").isin("", "imports") & (~go | F.col("symbol").rlike(GO_NAME)), F.col("symbol"))
    syms = F.filter(F.array(own), lambda x: x.isNotNull())
    if base is None:
        placed = rows.withColumn("syms", syms)
        by_line = F.col("_named") & (F.size("syms") == 0)
        return placed.withColumns({"lo": F.when(by_line, F.col("old_lo")), "hi": F.when(by_line, F.col("old_hi"))}).drop("_named")
    declared = base.filter(~F.col("path").endswith(".go") | ((F.col("name") != "imports") & F.col("name").rlike(GO_NAME)))
    points = rows.filter("_named").select("change_id", "id", "path", F.explode("points").alias("_p")).select("change_id", "id", "path", "_p.a", "_p.b")
    names = touched(points, declared.select("change_id", "path", "name", "start", "end", "ord"), ["change_id", "id"], ["change_id", "path"])
    none = F.array().cast("array<string>")
    met = rows.join(names, ["change_id", "id"], "left").withColumn("syms", F.array_distinct(F.concat(syms, F.coalesce("names", none))))
    return met.withColumns({"lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int")}).drop("names", "_named")


def unit_impacts(units: DataFrame, base: DataFrame | None, records: DataFrame, rules: list[dict], repo: str) -> DataFrame:
    """(change_id, id, matched, basis, also, chain, impact, impact_level, rollback) of units: see ``resolved``.

    All names of all units are one join with the map's symbols. The record of the highest impact is the basis, the others
    that were touched are also given; where no name has a record, the file's, its directory's or the repository's counts.
    """
    rows = resolved(units, base).select(F.struct("change_id", "id").alias("qid"), F.lit(repo).alias("repo"), "path", "syms", "lo", "hi", (F.col("status") == "added").alias("new_file"))
    found = fallback_lookup(rows, records, rules)
    rest = F.when(F.size("basis") > 1, F.slice("basis", F.lit(2), F.size("basis")))
    return found.select("qid.change_id", "qid.id", "matched", F.col("basis")[0].alias("basis"), F.coalesce(rest, F.array().cast("array<string>")).alias("also"), "chain", "impact", "impact_level", "rollback")
