"""Pipelines built from the operators: the map of a code base, lookups in it, and triage of change sets."""
