"""Texts: slugs and clips, references, URLs of services in literals, text slots of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a reference to a change and a service's URL look like.
CHANGE_URL = r"(?:^|https?://|\s)([a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?::\d+)?)/([^/\s]+)/([^/\s]+)/pull/(\d+)"
CHANGE_SHORT = r"^(?:([a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?::\d+)?)/)?([^/\s]+)/([^/\s#]+)#(\d+)$"
SERVICE_URL = r"""(?:^|[^/\w.-]|//[^/\s'"]+)/([a-z0-9][a-z0-9._-]*)(/[^\s'"?#]*)?"""


def slug(text: Column) -> Column:
    """Runs of letters and digits in lower case, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def tail(text: Column, lines: int = 15) -> Column:
    """The last lines of a trimmed text."""
    return F.substring_index(F.trim(text), "\n", -lines)


def first_line(text: Column) -> Column:
    return F.substring_index(F.trim(text), "\n", 1)


def change_reference(text: Column, default_host: str) -> Column:
    """struct(host, owner, repo, number) of a change's URL, of host/owner/repo#N or owner/repo#N; null of anything else."""
    t = F.trim(text)

    def made(pattern: str) -> Column:
        part = lambda i: F.regexp_extract(t, pattern, i)
        host = F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit(default_host))
        return F.struct(host.alias("host"), part(2).alias("owner"), F.regexp_replace(part(3), r"\.git$", "").alias("repo"), part(4).try_cast("int").alias("number"))

    return F.when(t.rlike(CHANGE_URL), made(CHANGE_URL)).when(t.rlike(CHANGE_SHORT), made(CHANGE_SHORT))


def service_urls(literal: Column) -> Column:
    """array<struct<service, path>> of the service calls in a literal; those without a path are left out."""
    services, paths = (F.regexp_extract_all(literal, F.lit(SERVICE_URL), F.lit(i)) for i in (1, 2))
    return F.filter(F.arrays_zip(services.alias("service"), paths.alias("path")), lambda x: F.coalesce(x["path"], F.lit("")).isin("", "/") == F.lit(False))


def expanded(template: Column, constants: Column, depth: int = 4) -> Column:
    """A template whose ${name} are replaced by constants (a map), also in what they hold, at most so deep; {} for others."""
    out = template
    for _ in range(depth + 1):
        parts = F.split(out, r"\$\{")
        done = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.coalesce(F.try_element_at(constants, F.substring_index(p, "}", 1)), F.lit("{}")), F.regexp_replace(p, r"^[^}]*\}?", "")))
        out = F.concat(parts[0], F.array_join(done, ""))
    return F.regexp_replace(out, r"\$\{[^}]*\}?", "")


def common_depth(a: Column, b: Column) -> Column:
    """How many directories two paths have in common from the root."""
    dirs = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    same = F.zip_with(dirs(a), dirs(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def slots(unit: Column) -> Column:
    """array<struct<slot, text>>: a unit's texts in their order: headline, summary, focus lines, issue titles."""
    of = lambda name, texts: F.transform(texts, lambda x, i: F.struct(F.concat(F.lit(name), F.lit("."), i.cast("string")).alias("slot"), x.alias("text")))
    one = lambda name: F.array(F.struct(F.lit(name).alias("slot"), unit[name].alias("text")))
    return F.concat(one("headline"), one("summary"), of("focus", unit["focus"]), of("issues", unit["issues"]))


def applied(unit: Column, texts: Column) -> Column:
    """The unit with other texts: empty ones, and lists of another length, keep what the unit has."""
    pick = lambda old, new: F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old)
    lists = lambda name: F.when(F.size(texts[name]) == F.size(unit[name]), F.zip_with(unit[name], texts[name], pick)).otherwise(unit[name])
    return F.struct(pick(unit["headline"], texts["headline"]).alias("headline"), pick(unit["summary"], texts["summary"]).alias("summary"), lists("focus").alias("focus"), lists("issues").alias("issues"))


def renamed(new: Column, old: Column) -> Column:
    """A value that older rows have under another name."""
    return F.coalesce(new, old)


#: A JSON string; its loops never give back, so that long ones are read in steps and not by recursion.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def outermost(text: Column) -> Column:
    """From the first { to the last } of the text; the trimmed text where there are none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def drop_nulls(text: Column) -> Column:
    """The JSON value in the text, written without spaces, keys in order, and without members that are null, at any depth,
    in objects within arrays too; a null that is an array's element keeps its place. Null for null and what isn't JSON (a
    repeated key isn't).

    parse_json settles spacing and escapes; in what to_json writes of it, strings are skipped whole, so :null can only
    follow a key.
    """
    plain = F.to_json(F.try_parse_json(outermost(text)))
    fewer = F.regexp_replace(plain, f"({_STRING})(?!:null)|{_STRING}:null,?+", "$1")
    return F.regexp_replace(fewer, f"({_STRING})|,(?=\\}})", "$1")
