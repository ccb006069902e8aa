"""Readers: change logs, diffs, maps; all with given schemas, none inferred."""
