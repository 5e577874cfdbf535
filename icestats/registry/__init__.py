"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ("teams", "functions", "market", "evaluation", "sequence", "people", "model", "files")


def load_all() -> None:
    for area in AREAS:
        import_module(f"icestats.registry.{area}")
