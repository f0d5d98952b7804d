"""Query plans: compositions of operators over the driver tables, with their SQL oracles."""


def all_queries():
    """Import every catalog module so that its queries register; returns the registry."""
    from . import (audit_queries, catalog, neardup_queries, placeholder_runs, source_queries, store_queries,  # noqa: F401
                   stream_queries, vector_queries)
    from .registry import REGISTRY

    return REGISTRY
