"""Operators for training-data pipelines over text, and their queries."""

from importlib import import_module

OPERATORS = (
    "quality", "language", "urls", "shards", "mixing", "fingerprints", "pieces", "wrappers", "jaccard", "passages",
    "lexical", "alignment", "secrets",
)


def registered():
    """(queries, SQL twins) of every operator."""
    for name in OPERATORS:
        import_module(f"icestats.llm.{name}")
    from icestats.llm.base import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
