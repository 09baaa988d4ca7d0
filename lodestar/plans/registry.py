"""Query registry: every query is a ``(spark, sf_dir) -> DataFrame`` callable,
optionally paired with an independent SQL oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
SECTION: dict[str, str] = {}


def register(key: str, sql: str | None = None, section: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        SECTION[key] = section
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    for mod in ("risk", "scalars", "aggs", "windows", "joins", "sources", "text", "stats", "causal", "impact",
                "ml", "domain", "streams"):
        try:
            importlib.import_module(f"lodestar.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"lodestar.plans.{mod}":
                raise
