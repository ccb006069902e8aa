"""Unified diffs as rows: files, hunks, numbered lines, and units of declarations, by windows over each diff's lines.

Rows of a diff are kept together by (change_id), and those of its hunks by (change_id, file_ord, hunk_ord), so many
change sets are read in one job. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.windows import islands

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _number(column: str, group: int, default: int):
    found = F.regexp_extract(column, _HUNK, group)
    return F.when(found == "", default).otherwise(found.cast("int"))


def parse_diff(diffs: DataFrame, normalise_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """diffs(change_id, text) to (files, lines).

    files: change_id, file_ord, path, old_path, status, binary, n_hunks. lines: change_id, file_ord, hunk_ord, line_ord,
    op, text, old_no, new_no, header. Headers count only before a file's first hunk, so a removed line that looks like
    one stays a line. A range of no lines begins one line further, unless normalise_empty is false.
    """
    rows = diffs.select("change_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    w = Window.partitionBy("change_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_file", F.col("line").startswith("diff --git ")).withColumn("file_ord", F.sum(F.col("_file").cast("int")).over(w).cast("int")).filter("file_ord > 0")
    f = Window.partitionBy("change_id", "file_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hunk", F.col("line").rlike(_HUNK)).withColumn("hunk_ord", F.sum(F.col("_hunk").cast("int")).over(f).cast("int"))
    head = rows.filter("hunk_ord = 0 OR _hunk").withColumn("_head", F.col("hunk_ord") == 0)
    take = lambda pattern: F.max(F.when(F.col("_head"), F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))))
    says = lambda pattern: F.coalesce(F.bool_or(F.col("_head") & F.col("line").rlike(pattern)), F.lit(False))
    made = head.groupBy("change_id", "file_ord").agg(
        F.regexp_extract(F.max(F.when(F.col("_file"), F.col("line"))), r"^diff --git a/(.*) b/(.*)$", 1).alias("_a"),
        F.regexp_extract(F.max(F.when(F.col("_file"), F.col("line"))), r"^diff --git a/(.*) b/(.*)$", 2).alias("_b"),
        take(r"^rename from (.*)$").alias("_from"),
        take(r"^rename to (.*)$").alias("_to"),
        says(r"^new file mode").alias("_new"),
        says(r"^deleted file mode").alias("_gone"),
        says(r"^(Binary files |GIT binary patch)").alias("binary"),
        F.count_if("_hunk").cast("int").alias("n_hunks"),
    )
    status = F.when(F.col("_new"), "added").when(F.col("_gone"), "deleted").when(F.col("_from").isNotNull(), "renamed").otherwise("modified")
    files = made.select("change_id", "file_ord", F.coalesce("_to", "_b").alias("path"), F.coalesce("_from", "_a").alias("old_path"), status.alias("status"), "binary", "n_hunks")
    h = Window.partitionBy("change_id", "file_ord", "hunk_ord")
    empty = 1 if normalise_empty else 0
    start = lambda no, n: _number("header", no, 0) + F.when(_number("header", n, 1) == 0, empty).otherwise(0)
    body = rows.filter("hunk_ord > 0").withColumn("header", F.max(F.when(F.col("_hunk"), F.col("line"))).over(h)).filter(~F.col("_hunk"))
    body = body.withColumn("op", F.substring("line", 1, 1)).filter(F.col("op").isin("+", "-", " "))
    before = h.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda ops: F.coalesce(F.sum(F.col("op").isin(ops).cast("int")).over(before), F.lit(0))
    lines = body.select(
        "change_id", "file_ord", "hunk_ord",
        F.row_number().over(h.orderBy("ord")).alias("line_ord"), "op", F.expr("substring(line, 2)").alias("text"),
        (start(1, 2) + count(["-", " "])).cast("int").alias("old_no"),
        (start(3, 4) + count(["+", " "])).cast("int").alias("new_no"), "header",
    )
    return files, lines


def units(files: DataFrame, lines: DataFrame, declarations: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each file's declaration that changes: change_id, id, file, old_path, symbol, status, added, removed, first line,
    hunks, and of the base side: its span (old_lo, old_hi) and points, array<struct<a, b>>: a removed line is both, and lines
    that are put in between a and b, without any removed right before them, are one.

    declarations(change_id, path, name, start, end, ord) are of the new side. A line belongs to the shortest that holds
    its new number; lines outside any stay with the run they stand in; runs without changes are dropped. A file without hunks
    (renamed as it was, binary) is one unit without lines. An added file is one unit, unless its diff has more than
    ``most`` characters; a deleted one has no declarations.
    """
    key = ["change_id", "file_ord", "hunk_ord", "line_ord"]
    size = lines.groupBy("change_id", "file_ord").agg(F.sum(F.char_length("text") + 2).alias("_chars"))
    large = F.lit(False) if most is None else F.coalesce(F.col("_chars") > most, F.lit(False))
    told = files.join(size, ["change_id", "file_ord"], "left").withColumn("_split", (F.col("status") != "deleted") & ((F.col("status") != "added") | large))
    named = lines.join(told.select("change_id", "file_ord", F.col("path").alias("file"), "old_path", "status", "_split"), ["change_id", "file_ord"])
    d = declarations.select("change_id", F.col("path").alias("file"), "name", "start", "end", "ord")
    held = named.filter("_split").select(*key, "file", "new_no").join(d, ["change_id", "file"]).filter((F.col("start") <= F.col("new_no")) & (F.col("new_no") <= F.col("end")))
    best = held.groupBy(*key).agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), "ord")).alias("symbol"))
    run = islands(named.join(best, key, "left"), ["change_id", "file_ord", "hunk_ord"], [F.col("line_ord")], "symbol")
    before = Window.partitionBy("change_id", "file_ord", "hunk_ord", "island").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    after_removed = F.coalesce(F.last(F.when(F.col("op") != "+", F.col("op")), ignorenulls=True).over(before) == "-", F.lit(False))
    between = F.struct((F.col("old_no") - (F.col("op") == "+").cast("int")).alias("a"), F.col("old_no").alias("b"))
    run = run.withColumn("point", F.when((F.col("op") == "-") | ((F.col("op") == "+") & ~after_removed), between))
    of_base = F.when(F.col("op") != "+", F.col("old_no"))
    parts = run.groupBy("change_id", "file_ord", "file", "old_path", "status", "hunk_ord", "island").agg(
        F.max("symbol").alias("symbol"),
        F.count_if(F.col("op") == "+").alias("added"),
        F.count_if(F.col("op") == "-").alias("removed"),
        F.min(F.when(F.col("op") != " ", F.col("new_no"))).alias("line"),
        F.coalesce(F.min(of_base), F.min("old_no")).alias("old_lo"),
        F.coalesce(F.max(of_base), F.min("old_no") + 1).alias("old_hi"),
        F.array_sort(F.collect_set("point")).alias("points"),
        F.array_sort(F.collect_list(F.struct("line_ord", "op", "text"))).alias("lines"),
    ).filter("added + removed > 0")
    symbol = F.coalesce("symbol", F.lit(""))
    id_ = F.when(symbol == "", F.col("file")).otherwise(F.concat_ws(":", "file", symbol))
    with_lines = parts.groupBy("change_id", "file_ord", "file", "old_path", "status", symbol.alias("symbol"), id_.alias("id")).agg(
        F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("line").alias("line"), F.count("*").alias("n_hunks"),
        F.min("old_lo").alias("old_lo"), F.max("old_hi").alias("old_hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("points")))).alias("points"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hunk_ord", "island", "lines"))), lambda x: x["lines"])).alias("lines"),
    )
    bare = files.filter("n_hunks = 0").select("change_id", "file_ord", F.col("path").alias("file"), "old_path", "status", F.lit("").alias("symbol"), F.col("path").alias("id"))
    return with_lines.unionByName(bare.select("*", *[F.lit(0).cast(with_lines.schema[c].dataType).alias(c) for c in ("added", "removed", "n_hunks")]), allowMissingColumns=True).withColumn("lines", F.coalesce("lines", F.array().cast(with_lines.schema["lines"].dataType)))
