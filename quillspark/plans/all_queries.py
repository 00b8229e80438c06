"""Imports every module that registers queries."""

from __future__ import annotations

from quillspark.plans import job_queries, more_queries, registry, study_queries, table_queries, text_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
