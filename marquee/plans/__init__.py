"""Registered queries, each with the SQL that must give the same rows."""

from . import (  # noqa: F401
    expression_queries,
    fuzzy_queries,
    list_queries,
    lookup_queries,
    quality_queries,
    recommend_queries,
    sketch_queries,
    source_queries,
    stream_queries,
    view_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
