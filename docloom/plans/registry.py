"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: registers ``f(spark, base)`` under ``name`` with its oracle SQL."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


_MODULES = ("retrieval_plans", "relational_plans", "text_plans", "matrix_plans", "stream_plans", "chunk_plans", "review_plans", "page_plans")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"docloom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, base: str) -> DataFrame:
    _load()
    return _QUERIES["ret_hybrid_topk"](spark, base)
