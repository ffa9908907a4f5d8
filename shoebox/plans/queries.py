"""Importing this module registers every query."""

from shoebox.plans import queries_browse, queries_change, queries_search, queries_tree  # noqa: F401
from shoebox.plans.registry import ORACLES, QUERIES  # noqa: F401
