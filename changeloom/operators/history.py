"""Change history: per-file statistics with recency, resets and bulk changes; co-change partners; incremental union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.patterns import commit_kind, follows_source, no_partner, skipped
from changeloom.functions.scalars import age_days, half_life
from changeloom.session import cut

#: Fixed values of the history: days, half life in days, files above which a change is bulk.
DAYS, HALF_LIFE, BULK = 365, 180, 40


def changes(commits: DataFrame) -> DataFrame:
    """commits(repo, hash, seq, ts, email, subject, files) as a row for each file; lockfiles and vendored code left out."""
    rows = commits.withColumn("_f", F.explode("files")).select(*[c for c in commits.columns if c != "files"], F.col("_f.status").alias("status"), F.col("_f.path").alias("path"))
    return rows.filter(~skipped(F.col("path")))


def in_window(ts: Column, ref: Column, days: int = DAYS) -> Column:
    """From so many days before ref to a minute after it."""
    age = age_days(ts, ref)
    return (age <= days) & (age >= -1 / 1440)


def file_history(rows: DataFrame, ref: Column, days: int = DAYS, hl: float = HALF_LIFE, bulk: int = BULK) -> DataFrame:
    """Statistics of each (repo, path) of changes(repo, hash, seq, ts, email, subject, status, path).

    Only what follows a file's last deletion counts. A bulk change counts for fixes, reverts, authors and age, but not
    for commits and recency. Of equal times the larger seq is earlier (histories list the newest first).
    """
    seen = rows.filter(in_window(F.col("ts"), ref, days))
    size = seen.groupBy("repo", "hash").agg(F.countDistinct("path").alias("_files"))
    at = F.struct("ts", (-F.col("seq")).alias("_late"))
    gone = seen.filter("status = 'D'").groupBy("repo", "path").agg(F.max(at).alias("_gone"))
    live = seen.join(size, ["repo", "hash"]).join(gone, ["repo", "path"], "left").filter(F.col("_gone").isNull() | (at > F.col("_gone"))).filter("status <> 'D'")
    kind, small = commit_kind(F.col("subject")), F.col("_files") <= bulk
    decay = half_life(age_days(F.col("ts"), ref), hl)
    one = live.withColumns({"_kind": kind, "_small": small, "_decay": decay}).dropDuplicates(["repo", "hash", "path"])
    return one.groupBy("repo", "path").agg(
        F.count_if("_small").alias("commits"),
        F.count_if(F.col("_kind") == "fix").alias("fixes"),
        F.count_if(F.col("_kind") == "revert").alias("reverts"),
        F.countDistinct("email").alias("authors"),
        F.coalesce(F.sum(F.when(F.col("_small"), F.col("_decay"))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.sum(F.when(F.col("_kind") == "fix", F.col("_decay"))), F.lit(0.0)).alias("recent_fixes"),
        F.floor(F.min(age_days(F.col("ts"), ref))).cast("int").alias("age_days"),
        F.min_by(F.when(F.col("status") == "A", F.col("email")), F.when(F.col("status") == "A", at)).alias("created"),
    )


def author_totals(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", "email").agg(F.countDistinct("hash").alias("commits"))


def cochange(events: DataFrame, group: str, item: str, min_n: int = 3, min_conf: float = 0.3, max_k: int = 5, bulk: int = BULK, extra: int = 5, partner_ok: Column | None = None, but: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(item, partner, n, conf, rk): what shares at least min_n groups with an item, and that share of the item's groups.

    Groups of more than ``bulk`` items make no pairs, so a group adds at most bulk * bulk pairs. Confidence is compared
    unrounded and given to two decimals. max_k + extra are ranked before partners are filtered (by partner_ok, and those in but(partner)), then max_k stay.
    With ``within``, a column that each group has one value of, items of different values are different items, and it is in the result and in but.
    """
    of = [] if within is None else [within]
    pairs_of = events.select(*of, F.col(group).alias("_g"), F.col(item).alias("item")).distinct()
    small = pairs_of.groupBy("_g").agg(F.count("*").alias("_n")).filter(F.col("_n") <= bulk).select("_g")
    kept = pairs_of.join(small, "_g", "left_semi")
    counts = kept.groupBy(*of, "item").agg(F.count("*").alias("_all"))
    both = kept.join(kept.withColumnRenamed("item", "partner"), ["_g", *of]).filter("item <> partner")
    n = both.groupBy(*of, "item", "partner").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)
    scored = n.join(counts, [*of, "item"]).withColumn("_conf", F.col("n") / F.col("_all")).filter(F.col("_conf") >= min_conf)
    order = Window.partitionBy(*of, "item").orderBy(F.desc("n"), "partner")
    if partner_ok is not None or but is not None:
        scored = scored.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= max_k + extra)
        scored = scored if partner_ok is None else scored.filter(partner_ok)
        scored = scored if but is None else scored.join(but.select(*of, "partner").distinct(), [*of, "partner"], "left_anti")
    ranked = scored.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= max_k)
    return ranked.select(*of, "item", "partner", "n", (F.floor(F.col("_conf") * 100 + 0.5).cast("double") / 100).alias("conf"), "rk")


def file_partners(rows: DataFrame, generated: DataFrame | None = None, **options) -> DataFrame:
    """Partners of files within their repo; files that change with everything are none, nor are mocks and generated(repo, path), which
    follow their source."""
    keyed = rows.filter("status <> 'D'").select("repo", F.concat_ws("\n", "repo", "hash").alias("g"), "path")
    wanted = ~no_partner(F.col("partner")) & ~follows_source(F.col("partner"), F.lit(False))
    but = None if generated is None else generated.select("repo", F.col("path").alias("partner"))
    return cochange(keyed, "g", "path", partner_ok=wanted, but=but, within="repo", **options)


def merge_history(fresh: DataFrame, old: DataFrame, since: Column, most: int | None = None) -> DataFrame:
    """Fresh commits and the old ones still in the window that aren't among them; the newest so many."""
    kept = old.filter(F.col("ts") >= since).join(fresh.select("repo", "hash"), ["repo", "hash"], "left_anti")
    both = fresh.unionByName(kept)
    return both if most is None else both.orderBy(F.desc("ts"), "seq").limit(most)


def add_unknown(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """What isn't known yet, added to it."""
    return known.unionByName(df.join(known, on, "left_anti").select(*known.columns))


def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo, hash): all of commits(repo, hash, parents) that are reached from starts(repo, hash), themselves included.

    Steps of 1, 2, 4, ... first parents are made once by pointer doubling; with them a whole line of history is reached in as many
    joins as its length has bits. Then the other parents of what was reached start lines of their own, until none is new: as
    many rounds as branches are merged into branches, not as many as there are commits. Unknown parents end a line.
    """
    jumps = [cut(commits.filter(F.size("parents") > 0).select("repo", "hash", F.col("parents")[0].alias("to")), measured=True)]
    while True:
        last = jumps[-1]
        twice = cut(last.join(last.select("repo", F.col("hash").alias("to"), F.col("to").alias("further")), ["repo", "to"]).select("repo", "hash", F.col("further").alias("to")), measured=True)
        if twice.isEmpty():
            break
        jumps.append(twice)
    merged = commits.filter(F.size("parents") > 1).select("repo", "hash", F.explode(F.slice("parents", F.lit(2), F.size("parents"))).alias("to")).distinct()
    there = commits.select("repo", "hash").distinct()
    reached, fresh = None, cut(starts.select("repo", "hash").distinct().join(there, ["repo", "hash"], "left_semi"), measured=True)
    while not fresh.isEmpty():
        line = fresh
        for jump in jumps:
            line = cut(line.unionByName(line.join(jump, ["repo", "hash"]).select("repo", F.col("to").alias("hash"))).distinct(), measured=True)
        line = line.join(there, ["repo", "hash"], "left_semi")
        new = line if reached is None else line.join(reached, ["repo", "hash"], "left_anti")
        new = cut(new, measured=True)
        reached = new if reached is None else cut(reached.unionByName(new), measured=True)
        beside = new.join(merged, ["repo", "hash"]).select("repo", F.col("to").alias("hash")).distinct()
        fresh = cut(beside.join(there, ["repo", "hash"], "left_semi").join(reached, ["repo", "hash"], "left_anti"), measured=True)
    return fresh if reached is None else reached


def is_ancestor(commits: DataFrame, marks: DataFrame) -> DataFrame:
    """marks(repo, old, new), one a repo, with ancestor: whether old is new or one of its ancestors."""
    reached = ancestors(commits, marks.select("repo", F.col("new").alias("hash"))).withColumn("ancestor", F.lit(True))
    return marks.join(reached.withColumnRenamed("hash", "old"), ["repo", "old"], "left").withColumn("ancestor", F.coalesce("ancestor", F.lit(False)))


def advance(known: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """What a newly read log adds to a history: its rows with mode ('append' or 'rebuild') and head, the repo's first row.

    known(repo, hash, parents) is the history so far, heads(repo, old) its high-water marks, log(repo, seq, hash, parents, ...)
    what was read, the newest commit first. Where the mark is an ancestor of the new head, commits that aren't known are added;
    where it isn't (history was rewritten), or there is none, the log replaces all that was known.
    """
    tips = log.groupBy("repo").agg(F.min_by("hash", "seq").alias("head"))
    both = known.select("repo", "hash", "parents").unionByName(log.select("repo", "hash", "parents")).dropDuplicates(["repo", "hash"])
    marks = heads.join(tips, "repo").select("repo", "old", F.col("head").alias("new"))
    held = is_ancestor(both, marks).filter("ancestor").select("repo", F.lit("append").alias("mode"))
    decided = tips.join(held, "repo", "left").withColumn("mode", F.coalesce("mode", F.lit("rebuild")))
    had = known.select("repo", "hash").distinct().withColumn("_had", F.lit(True))
    rows = log.join(decided, "repo").join(had, ["repo", "hash"], "left")
    return rows.filter("_had IS NULL OR mode = 'rebuild'").dropDuplicates(["repo", "hash"]).select(*log.columns, "mode", "head")
