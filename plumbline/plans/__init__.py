"""Queries over the driver's tables; importing the package registers all of them."""

from plumbline.plans import bridge, pages, replies, sheets
from plumbline.plans.registry import oracle_sql, queries

__all__ = ["bridge", "oracle_sql", "pages", "queries", "replies", "sheets"]
