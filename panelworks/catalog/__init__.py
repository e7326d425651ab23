"""Registered queries over the driver tables, each next to the SQL that checks it."""

from panelworks.catalog.registry import REGISTRY, Query, load_all

__all__ = ["REGISTRY", "Query", "load_all"]
