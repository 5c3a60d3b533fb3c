"""The registered queries: each operator bound to the driver's tables, with its SQL."""

from . import clinical, extra, files, match, requests, service, text

MODULES = (text, match, clinical, service, files, extra, requests)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
