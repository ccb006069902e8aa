"""How likely a change is to go wrong: experience, history around it, complexity it adds, tests and partners left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.patterns import is_test, test_candidates
from changeloom.functions.scalars import dirname, level, points, round_half_away, tally
from changeloom.operators.decisions import CHANGE_POINTS, PLACE_POINTS
from changeloom.operators.hierarchy import rollup_paths

#: Commits below which an author is new to a repository; what marks a bot.
NEWCOMER, BOT = 10, "[bot]"


def author_experience(changes: DataFrame, authors: DataFrame, history: DataFrame) -> DataFrame:
    """(change_id, repo, path, file_commits, repo_commits, created) of changes(change_id, repo, path).

    authors(change_id, email) are those of the change; history(repo, hash, email, path, status) is what was before. Bots
    don't count; without an author all is unknown: -1. Sums are over all authors of a change.
    """
    people = authors.filter(~F.col("email").contains(BOT)).select("change_id", "email").distinct()
    some = people.select("change_id").distinct().withColumn("_known", F.lit(True))
    by_file = history.groupBy("repo", "path", "email").agg(F.countDistinct("hash").alias("_file"), F.bool_or(F.col("status") == "A").alias("_made"))
    by_repo = history.groupBy("repo", "email").agg(F.countDistinct("hash").alias("_repo"))
    rows = changes.select("change_id", "repo", "path").distinct().join(people, "change_id", "left")
    met = rows.join(by_file, ["repo", "path", "email"], "left").join(by_repo, ["repo", "email"], "left")
    sums = met.groupBy("change_id", "repo", "path").agg(F.sum(F.coalesce("_file", F.lit(0))).alias("_f"), F.sum(F.coalesce("_repo", F.lit(0))).alias("_r"), F.coalesce(F.bool_or("_made"), F.lit(False)).alias("created"))
    known = sums.join(some, "change_id", "left")
    number = lambda c: F.when(F.col("_known"), F.col(c)).otherwise(-1).cast("bigint")
    return known.select("change_id", "repo", "path", number("_f").alias("file_commits"), number("_r").alias("repo_commits"), "created")


def directory_history(files: DataFrame, authors: DataFrame) -> DataFrame:
    """A row for each (repo, dir): sums of the files' (rounded) numbers, the smallest age known, distinct authors.

    files(repo, path, commits, fixes, reverts, recent, recent_fixes, age_days: -1 if never); authors(repo, path, email).
    """
    add = lambda c: round_half_away(F.sum(round_half_away(F.col(c), 2)), 2).alias(c)
    age = F.coalesce(F.min(F.when(F.col("age_days") >= 0, F.col("age_days"))), F.lit(-1)).alias("age_days")
    sums = rollup_paths(files, "path", [*(F.sum(c).alias(c) for c in ("commits", "fixes", "reverts")), add("recent"), add("recent_fixes"), age], ["repo"])
    people = rollup_paths(authors, "path", [F.countDistinct("email").alias("authors")], ["repo"])
    return sums.join(people, ["repo", "dir"], "left").withColumn("authors", F.coalesce("authors", F.lit(0).cast("bigint")))


def fixes_around(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(repo, path, dir_fixes): recency-weighted fixes to the other files of a file's directory."""
    own = files.select("repo", "path", dirname(F.col("path")).alias("dir"), "recent_fixes")
    met = own.join(dirs.select("repo", "dir", F.col("recent_fixes").alias("_dir")), ["repo", "dir"], "left")
    return met.select("repo", "path", F.greatest(F.lit(0.0), F.coalesce("_dir", F.lit(0.0)) - F.coalesce("recent_fixes", F.lit(0.0))).alias("dir_fixes"))


def spread(files: DataFrame) -> DataFrame:
    """(change_id, dirs): the directories that a change touches."""
    return files.groupBy("change_id").agg(F.countDistinct(dirname(F.col("path"))).alias("dirs"))


def complexity(picked: DataFrame, head: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """(key, cyclo, cyclo_base, nest, delta, names): the worst of the declarations that a change touches.

    picked(key, name); head and base(key, name, cyclo, nest, ord): those of each side, of which the last of a name counts.
    cyclo is the largest of the head, the first of equals, and cyclo_base is the same declaration's before; a declaration that
    is gone has a name but no numbers.
    """
    last = lambda df: df.groupBy(*key, "name").agg(F.max_by(F.struct("cyclo", "nest", "ord"), "ord").alias("d"))
    both = last(head).withColumnRenamed("d", "h").join(last(base).withColumnRenamed("d", "b"), [*key, "name"], "full")
    met = both.join(picked.select(*key, "name").distinct(), [*key, "name"])
    was = F.coalesce("b.cyclo", F.lit(0))
    best = F.max_by(F.struct(F.col("h.cyclo").alias("cyclo"), was.alias("was")), F.when(F.col("h").isNotNull(), F.struct("h.cyclo", -F.col("h.ord"))))
    return met.groupBy(*key).agg(
        best.alias("best"),
        F.coalesce(F.max("h.nest"), F.lit(0)).alias("nest"),
        F.greatest(F.lit(0), F.coalesce(F.max(F.col("h.cyclo") - was), F.lit(0))).alias("delta"),
        F.array_sort(F.collect_set("name")).alias("names"),
    ).select(*key, F.coalesce("best.cyclo", F.lit(0)).alias("cyclo"), F.coalesce("best.was", F.lit(0)).alias("cyclo_base"), "nest", "delta", "names")


def test_gaps(files: DataFrame, known: DataFrame) -> DataFrame:
    """(change_id, path, test_gap) of files(change_id, path, status): code changed and its test didn't.

    A Go file's tests are any of its directory; another file's is the first of its usual places that is known(path) before
    the change, and without one there is no gap.
    """
    path = F.col("path")
    code = files.filter((F.col("status") != "deleted") & ~is_test(path))
    changed = files.select("change_id", path.alias("_test")).distinct()
    tested = files.filter(is_test(path)).select("change_id", dirname(path).alias("_dir")).distinct().withColumn("_tested", F.lit(True))
    go = code.filter(path.endswith(".go")).withColumn("_dir", dirname(path)).join(tested, ["change_id", "_dir"], "left").select("change_id", "path", F.col("_tested").isNull().alias("test_gap"))
    rest = code.filter(~path.endswith(".go")).select("change_id", "path", F.posexplode(test_candidates(path)).alias("_pos", "_test"))
    first = rest.join(known.select(path.alias("_test")).distinct(), "_test").groupBy("change_id", "path").agg(F.min_by("_test", "_pos").alias("_test"))
    found = first.join(changed.withColumn("_changed", F.lit(True)), ["change_id", "_test"], "left").select("change_id", "path", F.col("_changed").isNull().alias("test_gap"))
    every = files.select("change_id", "path").distinct()
    return every.join(go.unionByName(found), ["change_id", "path"], "left").withColumn("test_gap", F.coalesce("test_gap", F.lit(False)))


def measured(measures: dict[str, Column], table: dict[str, tuple[float, float, float]]) -> Column:
    """array<struct<minus, place, name, value>>: each factor's points, negative, its place in the table and its value."""
    value = {n: F.coalesce(measures[n].cast("double"), F.lit(0.0)) for n in table if n in measures}
    return F.array(*[F.struct((-points(v, *table[n])).alias("minus"), F.lit(i).alias("place"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(value.items())])


def explained(factors: Column, says: dict[str, str], top: int) -> Column:
    """array<struct<name, points, why>> of the first factors that count (half a point or more), the most points first, then as
    in the table. ``says``: what a factor's measure means, with one %s for it. Only these few get a text."""
    first = F.slice(F.array_sort(F.filter(factors, lambda x: x["minus"] <= -0.5)), 1, top)
    text = F.create_map(*[F.lit(x) for kv in says.items() for x in kv])
    shown = lambda x: F.regexp_replace(F.format_string("%.1f", F.bround(x["value"], 1)), r"\.0$", "")
    why = lambda x: F.replace(F.coalesce(F.element_at(text, x["name"]), F.concat(x["name"], F.lit(": %s"))), F.lit("%s"), shown(x))
    return F.transform(first, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("points"), why(x).alias("why")))


#: What the factors of a change say.
SAYS = {
    "fixes": "%s recency-weighted fixes", "reverts": "%s reverts", "churn": "%s recency-weighted commits", "authors": "%s authors",
    "dir_fixes": "%s recency-weighted fixes to other files of the directory", "cyclo": "cyclomatic complexity %s", "nest": "nested %s deep",
    "cyclo_delta": "adds %s to cyclomatic complexity", "size": "%s changed lines", "new_to_file": "the author is new to the file (%s)",
    "newcomer": "the author is new to the repository (%s)", "cochange": "%s usual partners aren't in the change", "test_gap": "code changed and no test did (%s)",
    "diffusion": "the change touches %s directories", "fix_pr": "the change is a fix (%s)",
}


def change_likelihood(units: DataFrame, top: int = 5) -> DataFrame:
    """units with likelihood (0 to 100), likelihood_level, factors (the first ``top``) and a note where nothing is scored.

    units(path, skipped: a rule decided none, generated, status, recent_fixes, reverts, recent, authors, dir_fixes, cyclo, nest,
    delta, changed, file_commits, repo_commits, n_missing, test_gap, dirs, fix_pr); nulls count as 0, unknown experience
    is -1. What a rule skipped, generated code and tests score 0.
    """
    known = F.coalesce(F.col("repo_commits") >= 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    measures = {
        "fixes": F.col("recent_fixes"), "reverts": F.col("reverts"), "churn": F.col("recent"), "authors": F.col("authors"), "dir_fixes": F.col("dir_fixes"),
        "cyclo": F.col("cyclo"), "nest": F.col("nest"), "cyclo_delta": F.col("delta"), "size": F.col("changed"),
        "new_to_file": yes(known & (F.col("status") != "added") & (F.col("file_commits") == 0)), "newcomer": yes(known & (F.col("repo_commits") < NEWCOMER)),
        "cochange": F.col("n_missing"), "test_gap": yes(F.col("test_gap")), "diffusion": F.col("dirs"), "fix_pr": yes(F.col("fix_pr")),
    }
    table = {**PLACE_POINTS, **CHANGE_POINTS}
    why = F.when(F.col("skipped"), "not scored: a rule skipped it").when(F.col("generated"), "not scored: generated").when(is_test(F.col("path")), "not scored: test code")
    rows = units.withColumns({"_f": measured(measures, table), "note": why})
    score = F.when(F.col("note").isNotNull(), 0).otherwise(tally(F.transform("_f", lambda x: -x["minus"])))
    scored = rows.withColumns({"likelihood": score, "factors": F.when(F.col("note").isNull(), explained(F.col("_f"), SAYS, top))})
    return scored.withColumn("likelihood_level", level(F.col("likelihood"))).select(*units.columns, "likelihood", "likelihood_level", "factors", "note")
