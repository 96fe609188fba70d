"""All registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reports", "sequences", "spatial", "details", "rules", "measures", "batch", "outlines", "hops", "masks")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").SQL.items() if v}
