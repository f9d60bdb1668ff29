"""Queries of the core."""

from __future__ import annotations

from seamark.plans import formats, problems, reference


def queries() -> dict:
    return reference.queries() | formats.queries() | problems.queries()


def oracle_sql() -> dict[str, str]:
    return reference.oracle_sql() | formats.oracle_sql() | problems.oracle_sql()
