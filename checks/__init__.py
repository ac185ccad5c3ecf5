"""Queries over the driver's tables, one per operator, with their SQL twins."""

from importlib import import_module

from checks.registry import ORACLES, QUERIES

MODULES = (
    "series", "regime", "observations", "scoring", "parameters", "ensembles",
    "pairs", "closed_forms", "multipliers", "sources", "spatial", "plans",
)


def load() -> None:
    for name in MODULES:
        import_module(f"checks.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
