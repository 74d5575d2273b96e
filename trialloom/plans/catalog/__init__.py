"""All registered queries and their SQL counterparts."""

from importlib import import_module

from trialloom.plans.catalog.base import ORACLES, QUERIES

MODULES = ("sequences", "selections", "planning", "resampling", "checks", "files")
for _m in MODULES:
    import_module(f"trialloom.plans.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
