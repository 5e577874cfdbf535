"""Query registry: one name, one Spark callable, one SQL twin (or none)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from icestats.registry.views import VIEWS, TABLES, spark_text, duck_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Inputs:
    """Lazy access to the given tables and to the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                deps, text = VIEWS[name]
                self._made[name] = self.spark.sql(
                    re.sub(r"<(\w+)>", r"{\1}", spark_text(text).replace("{", "{{").replace("}", "}}")), **{d: getattr(self, d) for d in deps}
                )
            else:
                raise AttributeError(name)
        return self._made[name]


def _needed(names: set[str]) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in found:
            for dep in VIEWS[name][0]:
                visit(dep)
            found.append(name)

    for name in sorted(names):
        visit(name)
    return found


def with_views(sql: str) -> str:
    """Put the definitions of every derived view used in `sql` in front of it."""
    used = {n for n in VIEWS if re.search(rf"\b{n}\b", sql)}
    parts = [f"{n} AS (\n{re.sub(r'<(\w+)>', r'\1', duck_text(VIEWS[n][1]))}\n)" for n in _needed(used)]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB twin over the same tables."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return wrap
