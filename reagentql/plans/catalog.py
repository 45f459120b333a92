"""All registered queries over the driver tables, with the SQL that checks them."""

from __future__ import annotations

from reagentql.plans import extraction, files, more, ordering, parts, prompts, relational, reports, scores, texts

MODULES = (scores, relational, texts, extraction, reports, more, prompts, ordering, parts, files)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
