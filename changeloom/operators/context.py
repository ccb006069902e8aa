"""What of a change set a reviewer of one unit should see: moved code, callers, the same file, as far as there is room.

Pairs of units are found by postings: of lines that one adds and the other removes, and of names that a diff says. A pair
without such evidence is never made; a unit's other places come from one list of its change set, without its diffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import greedy_fill
from changeloom.operators.pairing import sharing, token

# Lines that show moved code, and room for other diffs.
LEAST_LINES, LEAST_BYTES, ROOM = 3, 12, 32_000

#: White space at the ends of a line.
BLANK = " \t\r\n\x0b\x0c"


def telling(line: Column) -> Column:
    """A trimmed line if it is long enough to tell something and no comment, else null."""
    own = F.btrim(line, F.lit(BLANK))
    return F.when((F.octet_length(own) >= LEAST_BYTES) & ~own.startswith("//"), own)


def significant(lines: Column, op: str) -> Column:
    """The distinct lines of an op that tell something."""
    own = F.transform(F.filter(lines, lambda x: x["op"] == op), lambda x: telling(x["text"]))
    return F.array_distinct(F.array_compact(own))


def identifier(symbol: Column) -> Column:
    """The name that other code uses, or null if it is too short to be looked for."""
    name = F.element_at(F.split(F.element_at(F.split(symbol, r"\s+"), -1), r"\."), -1)
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$") & (symbol != "imports"), name)


def moved_code(units: DataFrame) -> DataFrame:
    """(change_id, id, other, moved, sample): units whose added lines include at least LEAST_LINES that another unit, not skipped,
    removes; how many, and the longest of them (of equally long ones the first).

    units(change_id, id, skipped, added, removed). Tokens are ordered by how many units of the change set remove the line.
    """
    lines = lambda side: units.select("change_id", "id", "skipped", F.explode(side).alias("line")).withColumn("tok", token(F.col("line")))
    removed = lines("removed").filter(~F.col("skipped"))
    often = removed.groupBy("change_id", "tok").agg(F.count("*").alias("df"))
    sets = lambda rows: rows.join(often, ["change_id", "tok"]).groupBy("change_id", F.col("id").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("x")).select("change_id", "unit", F.col("x.tok").alias("toks"))
    found = sharing(sets(lines("added")), sets(removed), ["change_id"], LEAST_LINES)
    text = lambda name, side: units.select("change_id", F.col("id").alias(name), F.col(side).alias(f"{side}_of_{name}"))
    met = found.join(text("a", "added"), ["change_id", "a"]).join(text("b", "removed"), ["change_id", "b"])
    common = F.array_intersect("added_of_a", "removed_of_b")
    longest = F.array_min(F.transform(common, lambda x: F.struct((-F.octet_length(x)).alias("n"), x.alias("line"))))["line"]
    return met.select("change_id", F.col("a").alias("id"), F.col("b").alias("other"), F.col("shared").alias("moved"), longest.alias("sample"))


def mentions(units: DataFrame) -> DataFrame:
    """(change_id, id, other): pairs of which one's diff says the other's name as a whole word, both ways round.

    units(change_id, id, name, diff). Only words that are names in the change set are joined.
    """
    names = units.filter("name IS NOT NULL").select("change_id", F.col("name").alias("word"), F.col("id").alias("other"))
    words = units.select("change_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("diff", F.lit("([A-Za-z0-9_]+)")))).alias("word"))
    said = words.join(names, ["change_id", "word"]).filter("id <> other").select("change_id", "id", "other")
    return said.unionByName(said.select("change_id", F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def review_context(units: DataFrame, room: int = ROOM) -> DataFrame:
    """(change_id, id, moved, shown, hidden) for units(change_id, id, file, symbol, lines, skipped, ord).

    Others of the change set come in the order of: code moved from them, mentions either way, the same file, the rest;
    each is shown while it fits, and one too long is passed over. A unit that is alone has empty lists.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["op"], x["text"])), "\n")
    u = units.select("change_id", "id", "file", "ord", "skipped", identifier(F.col("symbol")).alias("name"), significant(F.col("lines"), "+").alias("added"), significant(F.col("lines"), "-").alias("removed"), text.alias("diff"))
    moved = moved_code(u)
    pairs = moved.withColumn("rank", F.lit(0)).unionByName(mentions(u).withColumn("rank", F.lit(1)), allowMissingColumns=True)
    best = pairs.groupBy("change_id", "id", "other").agg(F.min_by(F.struct("rank", "moved", "sample"), "rank").alias("e")).select("change_id", "id", "other", "e.*")
    ranks = best.groupBy("change_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("other", F.struct("rank", "moved", "sample")))).alias("evidence"))
    all_ = u.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "file", F.octet_length("diff").alias("n"), "skipped"))).alias("all"))
    met = u.select("change_id", "id", "file").join(all_, "change_id").join(ranks, ["change_id", "id"], "left")
    known = lambda x: F.try_element_at("evidence", x["id"])
    place = lambda x: F.coalesce(known(x)["rank"], F.when(x["file"] == F.col("file"), 2).otherwise(3))
    item = lambda x: F.struct(place(x).alias("rank"), x["ord"].alias("ord"), x["id"].alias("id"), x["n"].alias("n"), known(x)["moved"].alias("moved"), known(x)["sample"].alias("sample"))
    open_ = met.withColumn("_open", F.array_sort(F.transform(F.filter("all", lambda x: (x["id"] != F.col("id")) & ~x["skipped"]), item))).withColumn("_taken", greedy_fill(F.transform("_open", lambda x: x["n"]), room))
    chosen = open_.withColumn("_both", F.arrays_zip(F.col("_open").alias("o"), F.col("_taken").alias("t")))
    ids = lambda want: F.transform(F.filter("_both", lambda x: x["t"] == F.lit(want)), lambda x: x["o"]["id"])
    hidden = F.array_sort(F.concat(ids(False), F.transform(F.filter("all", lambda x: x["skipped"] & (x["id"] != F.col("id"))), lambda x: x["id"])))
    from_ = F.transform(F.filter("_open", lambda x: x["moved"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), x["moved"].alias("lines"), x["sample"].alias("sample")))
    return chosen.select("change_id", "id", from_.alias("moved"), ids(True).alias("shown"), hidden.alias("hidden"))
