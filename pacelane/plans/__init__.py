"""All registered queries."""

import importlib

from pacelane.plans.registry import ORACLE, QUERIES, SURVEY

MODULES = ("motion", "series", "joining", "sensors", "posture", "pitch", "cleaning", "league", "lineage", "seasons", "serving", "checks", "cataloging", "reading", "streams")

for _name in MODULES:
    importlib.import_module(f"pacelane.plans.{_name}")

__all__ = ["ORACLE", "QUERIES", "SURVEY"]
