"""Registered queries over the given tables, each next to its SQL oracle."""

from importlib import import_module

_FAMILIES = (
    "table_queries", "align_queries", "rate_queries", "price_queries", "text_queries", "cross_queries", "curate_queries", "score_queries", "corpus_queries", "ingest_queries", "status_queries", "family_queries", "window_queries", "search_queries", "warning_queries",
)


def load_queries():
    """All builders and oracles, by query name."""
    from finframe.plans import base

    for family in _FAMILIES:
        import_module(f"finframe.plans.{family}")
    return base.BUILDERS, base.ORACLES
