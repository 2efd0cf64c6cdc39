"""All registered queries."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _part in ("fields", "rules", "merges", "risks", "queues", "vectors", "pages", "models", "streams"):
    import_module(f"{__name__}.{_part}")

__all__ = ["ORACLES", "QUERIES"]
