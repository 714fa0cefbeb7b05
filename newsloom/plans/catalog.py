"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from newsloom.plans import digest_sql, operations, registry, stories, streams, texts, triage, writes

MODULES = [operations, texts, stories, streams, triage, writes, digest_sql]


def queries() -> dict:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
