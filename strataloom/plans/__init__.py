"""Plans of the engine: the registered queries, by family."""

from . import aggregate_queries, filter_queries, graph_queries, join_queries, ranking_queries, source_queries, state_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Tables, query  # noqa: F401
