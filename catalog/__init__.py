"""Every registered query on the test tables, with the oracle SQL of those that have one."""

from importlib import import_module

GROUPS = ["reports", "cleaning", "quality", "features", "stats", "frames", "metrics", "model"]

QUERIES = {}
ORACLES = {}
for _group in GROUPS:
    QUERIES |= import_module(f"catalog.{_group}").QUERIES
    ORACLES |= import_module(f"oracle.{_group}").ORACLES
