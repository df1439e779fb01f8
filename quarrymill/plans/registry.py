"""Every query of the library's own operators, with the SQL it equals."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flagship_search_eval"
MODULES = ("retrieval", "tables", "documents", "interfaces", "streams")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"quarrymill.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
