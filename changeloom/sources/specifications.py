"""Specifications of interfaces in YAML: operations with their spans, read from the indentation of lines.

The few levels that name an operation (section, path, method, identifier) are each the smallest indentation within the one
above, so windows over a file's lines find them; what is deeper, texts in blocks too, is never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Methods of operations.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]

_KEY = r"""^( *)("[^"]+"|'[^']+'|[^\s#"'\-{\[](?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?:\s+(.*?))?\s*$"""


def _bare(text: Column) -> Column:
    """Without a comment, and without quotes around it."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(^|\s)#.*$", "")), r"""^(["'])(.*)\1$""", "$2")


def _keys(files: DataFrame) -> DataFrame:
    """files(repo, path, text) as (repo, path, line, raw, indent, key, value, top: the section), of files that are specifications."""
    rows = files.select("repo", "path", F.posexplode(F.split("text", "\r?\n")).alias("_no", "raw")).withColumn("line", F.col("_no") + 1)
    named = rows.withColumn("key", F.nullif(_bare(F.regexp_extract("raw", _KEY, 2)), F.lit("")))
    named = named.withColumns({"indent": F.when(F.col("key").isNotNull(), F.length(F.regexp_extract("raw", _KEY, 1))), "value": _bare(F.regexp_extract("raw", _KEY, 3))})
    file = Window.partitionBy("repo", "path")
    so_far = file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = named.withColumns({"top": F.last(F.when(F.col("indent") == 0, F.col("key")), ignorenulls=True).over(so_far), "_spec": F.max((F.col("indent") == 0) & F.col("key").isin("openapi", "swagger")).over(file)})
    return marked.filter("_spec").select("repo", "path", "line", "raw", "indent", "key", "value", "top")


def operations(files: DataFrame) -> DataFrame:
    """(repo, path, name, method, url, start, end) of the operations of files(repo, path, text).

    An operation without an identifier is named by method and path. It ends where the next one starts, the last one before the section
    ``components`` that follows it, or at the end of the file. Keys may be quoted, an operation may stand on one line in braces.
    """
    rows = _keys(files)
    by = ["repo", "path"]
    upto = lambda *more: Window.partitionBy(*by, *more).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    least = lambda above, *more: F.min(F.when(F.col("indent") > above, F.col("indent"))).over(Window.partitionBy(*by, *more))
    ends = rows.groupBy(*by).agg(F.max("line").alias("_lines"), F.min(F.when((F.col("indent") == 0) & (F.col("key") == "components"), F.col("line"))).alias("_after"))
    x = rows.filter("top = 'paths' AND indent > 0").withColumn("_i", least(F.lit(0)))
    x = x.withColumn("_path", F.last(F.when(F.col("indent") == F.col("_i"), F.struct("line", "key")), ignorenulls=True).over(upto()))
    x = x.withColumn("_at", F.col("_path.line")).withColumn("_i", least(F.col("_i"), "_at"))
    method = F.when(F.lower("key").isin(METHODS), F.struct("line", F.upper("key").alias("method"), "value")).otherwise(F.struct(F.lit(-1).alias("line"), F.lit("").alias("method"), F.lit("").alias("value")))
    x = x.withColumn("_op", F.last(F.when(F.col("indent") == F.col("_i"), method), ignorenulls=True).over(upto("_at"))).filter("_op.line > 0")
    x = x.withColumn("start", F.col("_op.line")).withColumn("_i", least(F.col("_i"), "start"))
    told = F.max(F.when((F.col("indent") == F.col("_i")) & (F.col("key") == "operationId"), F.col("value")))
    found = x.groupBy(*by, "start", F.col("_op.method").alias("method"), F.col("_path.key").alias("url"), F.regexp_extract("_op.value", r"""operationId:\s*["']?([^,}\s"']+)""", 1).alias("_short")).agg(told.alias("_told"))
    name = F.coalesce(F.nullif(F.col("_told"), F.lit("")), F.nullif(F.col("_short"), F.lit("")), F.concat_ws(" ", "method", "url"))
    next_ = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    last = F.when(F.col("_after") > F.col("start"), F.col("_after") - 1).otherwise(F.col("_lines"))
    return found.join(ends, by).select(*by, name.alias("name"), "method", "url", "start", F.coalesce(next_ - 1, last).alias("end"))


def servers(files: DataFrame) -> DataFrame:
    """(repo, path, servers): the URLs of servers in their order, and the base path after them."""
    url = F.when(F.col("top") == "servers", _bare(F.regexp_extract("raw", r"^\s*(?:-\s+)?url:\s+(.*)$", 1)))
    base = F.when((F.col("indent") == 0) & (F.col("key") == "basePath"), F.col("value"))
    given = _keys(files).withColumn("_s", F.coalesce(F.nullif(url, F.lit("")), base)).withColumn("_later", base.isNotNull())
    listed = given.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_later", "line", "_s")))).alias("s"))
    return listed.select("repo", "path", F.transform("s", lambda x: x["_s"]).alias("servers"))
