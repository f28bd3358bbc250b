"""Registered queries: a key, a plan over the domain tables and, where SQL can
say the same, an oracle in plain SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import prepare
from .views import Tables, with_views

AS_OF = "2024-01-31 00:00:00"

_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        if key in _PLANS:
            raise ValueError(f"query {key} registered twice")
        _PLANS[key] = plan
        if oracle is not None:
            _ORACLES[key] = with_views(oracle)
        return plan

    return register


def _load() -> None:
    from . import queries_feeds, queries_jobs, queries_scans, queries_urls  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(Tables(prepare(spark), sf_dir))

    return {key: bind(plan) for key, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
