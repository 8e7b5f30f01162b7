"""End-to-end flows and the query catalogue."""

QUERY_MODULES = ["index_queries", "series_queries", "text_queries", "source_queries", "model_queries", "store_queries"]


def load_catalog():
    """(queries, oracles) of all registered queries."""
    from importlib import import_module

    from .catalog import ORACLES, QUERIES

    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
