"""All registered queries."""

from __future__ import annotations

from claridoc.plans import queries_audit, queries_contrast, queries_live, queries_review, queries_stream, queries_text  # noqa: F401
from claridoc.plans.registry import QUERIES, checks


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(checks())
