"""Text predicates and cascades over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import patterns
from changeloom.functions.texts import drop_nulls
from changeloom.queries import query, table


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^(Revert|revert)\\b') THEN 'revert'
 WHEN regexp_matches(text, '(?i)\\b(fix(es|ed|ing)?|bug(fix)?|hotfix|regression|incident|outage|crash(es|ed)?|panic(s|ed)?|broken|leak)\\b')
  AND NOT regexp_matches(text, '(?i)\\b(typos?|lint(er|ing)?|flaky|spelling|readme|docs?|comments?|format(ting)?)\\b') THEN 'fix' ELSE '' END AS kind FROM documents""")
def commit_kind_regex(spark, sf):
    return table(spark, sf, "documents").select("doc_id", patterns.commit_kind(F.col("text")).alias("kind"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'generated' WHEN text LIKE '%!!%' THEN 'attributes'
 WHEN list_bool_or([x LIKE '%Code generated%' AND x LIKE '%DO NOT EDIT%' FOR x IN string_split(substr(text, 1, 2048), chr(10))]) THEN 'header'
 WHEN length(text) < 300 THEN 'short' WHEN lang <> 'en' THEN 'docs' END AS rule FROM documents""")
def ordered_rule_cascade(spark, sf):
    t = F.col("text")
    rules = [(t.rlike("[#$%&*]{3}"), "generated"), (t.contains("!!"), "attributes"), (patterns.generated_header(t), "header"), (F.char_length(t) < 300, "short"), (F.col("lang") != "en", "docs")]
    return table(spark, sf, "documents").select("doc_id", patterns.cascade([(c, F.lit(n)) for c, n in rules]).alias("rule"))


@query("""SELECT event_id, CASE WHEN k BETWEEN 0 AND 49 THEN 'skim' WHEN k BETWEEN 50 AND 99 THEN 'human' ELSE 'none' END AS bucket, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def json_prop_decode(spark, sf):
    k = F.from_json("props", "k INT")["k"]
    bucket = F.when(k.between(0, 49), "skim").when(k.between(50, 99), "human").otherwise("none")
    return table(spark, sf, "events").select("event_id", bucket.alias("bucket"), k.alias("k"))


@query("""
WITH b AS (SELECT DISTINCT trim(l, ' ') AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE strlen(trim(l, ' ')) >= 12),
d AS (SELECT DISTINCT doc_id, trim(l, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
SELECT doc_id, count(*) AS shared, max(strlen(line)) AS longest FROM d JOIN b USING (line) GROUP BY doc_id""")
def moved_lines_intersect(spark, sf):
    """Significant lines (12 bytes or more) that a document shares with the benchmark."""
    lines = lambda df, *keys: df.select(*keys, F.explode(F.split("text", "\n")).alias("l")).select(*keys, F.trim("l").alias("line")).distinct()
    known = lines(table(spark, sf, "benchmark")).filter(F.octet_length("line") >= 12)
    met = lines(table(spark, sf, "documents"), "doc_id").join(known, "line")
    return met.groupBy("doc_id").agg(F.count("*").alias("shared"), F.max(F.octet_length("line")).cast("bigint").alias("longest"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS shown, length(text) > 500 AS truncated FROM documents""")
def truncate_with_mark(spark, sf):
    from changeloom.functions.scalars import truncated

    return table(spark, sf, "documents").select("doc_id", truncated(F.col("text"), 500, "...").alias("t")).select("doc_id", F.col("t.text").alias("shown"), "t.truncated")


@query("""SELECT event_id, CASE k % 4 WHEN 3 THEN NULL ELSE
 '{"kind":{' || CASE k % 4 WHEN 0 THEN '"l":[null,{"z":' || k || '},[{}]],' ELSE '' END || '"s":"\\":null,}' || event_type || '"}' || CASE k % 4 WHEN 2 THEN ',"z":' || k ELSE '' END || '}' END AS answer
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def answers_without_nulls(spark, sf):
    """Answers made of events: nulls first, last, alone, nested and in arrays; strings that look like them; cut answers."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = F.concat(F.lit(r'"s": "\":null,}'), F.col("event_type"), F.lit('"'))
    lists = F.format_string('"l": [null, {"y": null, "z": %s, "n": null}, [{"x": null}]], "m": null', k)
    answer = (
        F.when(k % 4 == 0, F.concat(F.lit('Here: {"kind": {"a": null, '), s, F.lit(", "), lists, F.lit('}, "b": null} so.')))
        .when(k % 4 == 1, F.concat(F.lit('{"a": null, "kind": {'), s, F.lit(', "t": null}}')))
        .when(k % 4 == 2, F.concat(F.lit('```json\n{\n "z": '), k.cast("string"), F.lit(',\n "y" : null,\n "kind": {'), s, F.lit("}\n}\n```")))
        .otherwise(F.concat(F.lit('{"kind": {'), s))
    )
    return table(spark, sf, "events").select("event_id", drop_nulls(answer).alias("answer"))
