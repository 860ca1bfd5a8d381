"""Named queries on the driver tables, and their DuckDB SQL."""

from importlib import import_module

MODULES = ("core", "series", "io", "shapes", "fits", "overlay", "arrangement", "fields", "imports")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").SQL.items()}
