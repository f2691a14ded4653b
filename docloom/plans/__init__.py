"""Queries over the driver tables, one module a group of operators."""

from docloom.plans import document_queries, integrity_queries, package_queries, range_queries, scalar_queries, style_queries, tree_queries, word_queries  # noqa: F401
from docloom.plans.registry import QUERIES, SQL  # noqa: F401
