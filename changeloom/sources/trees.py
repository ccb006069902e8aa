"""Trees of files: listings, manifests, workspaces, attributes, contents by side, and what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below a folder, the path relative to it; Spark's own reader finds and splits them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = F.lit(path.split("://", 1)[-1].rstrip("/") + "/")
    at = F.position(root, F.col("path"))
    return files.select(F.substring(F.col("path"), at + F.length(root), F.length("path")).alias("path"), "content")


def listing(tracked: DataFrame, present: DataFrame) -> DataFrame:
    """(repo, path) of the tracked paths that are there, each once."""
    return tracked.select("repo", "path").distinct().join(present.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def modules(manifests: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(repo, dir, module): the first module line of each manifest(repo, path, text); directories that match are left out."""
    first = F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)
    made = manifests.select("repo", F.regexp_replace(F.col("path"), r"/?[^/]*$", "").alias("dir"), first.alias("module")).filter("module <> ''")
    for pattern in excluded or []:
        made = made.filter(~F.col("dir").rlike(pattern))
    return made


def workspace(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, category) of the directories found(repo), with the category that the listed(repo, category) have, else 'unlisted'."""
    return found.select("repo").distinct().join(listed.select("repo", "category"), "repo", "left").withColumn("category", F.coalesce("category", F.lit("unlisted")))


def generated_attributes(attributes: DataFrame) -> DataFrame:
    """(repo, pattern, ord) of the patterns that .gitattributes(repo, text) mark as generated."""
    lines = attributes.select("repo", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    fields = F.filter(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), lambda x: x != "")
    rows = lines.select("repo", "ord", fields.alias("f")).filter((F.size("f") >= 2) & ~F.col("f")[0].startswith("#"))
    marks = F.exists(F.slice("f", 2, F.size("f")), lambda x: x.isin("linguist-generated", "linguist-generated=true"))
    return rows.filter(marks).select("repo", F.col("f")[0].alias("pattern"), "ord")


def real_changes(files: DataFrame, without_space: DataFrame) -> DataFrame:
    """files(change_id, path, n_hunks) with ``real``: whether the diff that ignores white space has hunks there too."""
    real = without_space.filter("n_hunks > 0").select("change_id", "path").distinct().withColumn("_real", F.lit(True))
    return files.join(real, ["change_id", "path"], "left").withColumn("real", F.coalesce("_real", F.lit(False))).drop("_real")


def contents(files: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """files(path, old_path, status) with the content of both sides, from head(path, content) and base(path, content): a
    saved diff with two trees, or two revisions. A side that has no such file is null."""
    met = files.join(head.select("path", F.col("content").alias("head_content")), "path", "left")
    return met.join(base.select(F.col("path").alias("old_path"), F.col("content").alias("base_content")), "old_path", "left")


def stale(existing: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """What exists and isn't among the current: shards to remove."""
    return existing.select(*on).distinct().join(current.select(*on).distinct(), on, "left_anti")


def changed_repos(now: DataFrame, before: DataFrame, version: int) -> DataFrame:
    """now(repo, fingerprint) whose graphs have to be made again: no cached graph(repo, fingerprint, version) of this version
    and fingerprint. The others are read from the cache; ranks are always made of all."""
    kept = before.filter(F.col("version") == version).select("repo", "fingerprint")
    return now.join(kept, ["repo", "fingerprint"], "left_anti")


def write_graph(rows: DataFrame, path: str, version: int) -> None:
    """A cache of graphs as compressed JSON, a folder for each repository; only the repositories of rows are replaced."""
    stamped = rows.withColumn("version", F.lit(version))
    stamped.write.partitionBy("repo").option("compression", "gzip").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """The cached rows of this version."""
    return spark.read.schema(f"{schema}, version INT, repo STRING").json(path).filter(F.col("version") == version).drop("version")


def replaced_cache(old: DataFrame, fresh: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """A parse cache after a run: fresh entries, and old ones of what is still there and wasn't parsed again."""
    kept = old.join(fresh.select(*key), key, "left_anti").join(current.select(*key).distinct(), key, "left_semi")
    return fresh.unionByName(kept)


def translations(texts: DataFrame, cache: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(known, wanted) of texts(key, text): translations of the cache(key, language, hash, translated) whose hash is that of
    the text as it is, and the texts to translate anew. English isn't translated."""
    hashed = texts.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    own = cache.filter(F.col("language") == language).select("key", "hash", "translated")
    known = hashed.join(own, ["key", "hash"])
    wanted = hashed.join(own.select("key", "hash"), ["key", "hash"], "left_anti")
    return known, wanted.filter(F.lower(F.lit(language)) != "english")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case, repo, diff, labels, must_find, must_not) of fixtures, a JSON file each. Each must name a diff or a change,
    and not both."""
    rule = "ARRAY<STRUCT<unit: STRING, match: STRING, min_severity: STRING, max_severity: STRING>>"
    rows = spark.read.schema(f"name STRING, pr STRING, diff STRING, labels MAP<STRING, STRING>, must_find {rule}, must_not {rule}").option("multiLine", True).json(path)
    named = rows.withColumn("case", F.coalesce("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))).drop("name")
    checked = F.when(F.col("pr").isNull() == F.col("diff").isNull(), F.raise_error(F.format_string("%s: give one of pr and diff", F.col("case"))))
    return named.withColumn("case", F.coalesce(checked, F.col("case")))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of a map: weights, levels, reasons of rules, rules that need a path alone, the commit of each repository."""
    rule = "ARRAY<STRUCT<id: STRING, score: INT, cap: INT, floor: INT, path: ARRAY<STRING>, not_path: ARRAY<STRING>, repo: ARRAY<STRING>, category: ARRAY<STRING>>>"
    schema = f"version INT, history_days INT, levels MAP<STRING, INT>, reasons MAP<STRING, STRING>, rules {rule}, repos MAP<STRING, STRUCT<commit: STRING, dirty: BOOLEAN, category: STRING>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def path_rules(rules: list[dict]) -> list[dict]:
    """The rules that need nothing of a symbol, which a lookup of an unmapped path can apply."""
    return [r for r in rules if not any(r.get(k) is not None and r.get(k) != [] for k in ("kind", "tags", "sym", "exported"))]


def merged_policy(defaults: dict, given: dict) -> dict:
    """A policy over its defaults: lists are appended, numbers replace if above 0, budgets are merged field by field."""
    out = {k: list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for key, value in given.items():
        if key not in defaults:
            raise ValueError(f"unknown policy field {key}")
        if isinstance(value, list):
            out[key] = [*out[key], *value]
        elif isinstance(value, dict):
            for name, fields in value.items():
                out[key][name] = {**out[key].get(name, {}), **{k: v for k, v in fields.items() if v}} if isinstance(fields, dict) else fields
        elif not isinstance(value, (int, float)) or value > 0:
            out[key] = value
    return out


def newest(results: DataFrame, key: str = "key", created: str = "created_at") -> DataFrame:
    """The newest cached result of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(created))
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
