"""Registered queries of the core engine and their SQL."""

from streetloom.plans.core import core_queries, flagship
from streetloom.plans.oracle import core_oracle_sql

__all__ = ["core_oracle_sql", "core_queries", "flagship"]
