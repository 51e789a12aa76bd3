"""Registered queries, each with the SQL that checks it."""

from stallwise.plans import carts, catalogue, changes, feedback, stored, streams, texts, visits  # noqa: F401
from stallwise.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
