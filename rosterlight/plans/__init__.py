"""Registered queries and the refresh; importing the package registers all of them."""

from . import queries, table_queries  # noqa: F401
