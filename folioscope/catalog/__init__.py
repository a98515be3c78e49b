"""Registered queries by operator, with the SQL that checks them."""

from importlib import import_module

_MODULES = ("files_and_pages", "joins_and_counts", "search_and_vectors", "jobs")


def _load():
    for name in _MODULES:
        import_module(f"folioscope.catalog.{name}")
    from folioscope.catalog import registry

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().SQL)
