"""Imports every module that registers queries."""

from callweave.plans import archive_queries, source_queries, stats_queries, voice_queries  # noqa: F401
