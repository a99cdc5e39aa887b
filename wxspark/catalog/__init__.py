"""All registered queries. Importing the modules fills the registry."""

import importlib

from wxspark.catalog.base import ORACLES, QUERIES

for _module in ("features", "cleaning", "series", "models", "places", "plans", "tables"):
    importlib.import_module(f"wxspark.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
