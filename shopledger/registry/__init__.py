from . import kept, operators, reports  # noqa: F401  (registering the queries)
from .base import QUERIES, oracle_queries, run

__all__ = ["QUERIES", "oracle_queries", "run"]
