"""Schemas of the tables that the pipelines read and write."""

from __future__ import annotations

NODE = "key STRING, kind STRING, repo STRING, file STRING, dir STRING, sym STRING, start INT, end INT, exported BOOLEAN, tags ARRAY<STRING>, internal BOOLEAN, cyclo INT, nest INT"
EDGE = "src STRING, dst STRING, n INT, kind STRING"
FILE = "repo STRING, path STRING, lang STRING, lines INT, generated BOOLEAN"
COMMIT = "repo STRING, hash STRING, ts TIMESTAMP_NTZ, email STRING, subject STRING, seq BIGINT, files ARRAY<STRUCT<status: STRING, path: STRING>>"
MAP_RECORD = "id STRING, level STRING, repo STRING, path STRING, sym STRING, kind STRING, lines ARRAY<INT>, impact INT, impact_level STRING, likelihood INT, likelihood_level STRING, rank DOUBLE, pr DOUBLE, rank_source STRING, rollback INT, rollback_tags ARRAY<STRUCT<tag: STRING, score: INT>>, callers BIGINT, symbols BIGINT, impact_cap INT, generated BOOLEAN"
QUERY = "qid BIGINT, repo STRING, path STRING, sym STRING, lo INT, hi INT, new_file BOOLEAN"
