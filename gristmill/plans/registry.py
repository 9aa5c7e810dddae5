"""Importing this fills the catalogue."""

from gristmill.plans import queries_generate, queries_rules, queries_scoring  # noqa: F401
