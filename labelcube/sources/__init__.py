"""Cubes from tables."""

from .tables import activity, by_nation, embeddings, sales_day, sales_month

__all__ = ["activity", "by_nation", "embeddings", "sales_day", "sales_month"]
