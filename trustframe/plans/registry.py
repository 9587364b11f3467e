"""Registry of queries: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    run: Query
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in PLANS:
            raise ValueError(f"query {name!r} is already registered")
        PLANS[name] = Plan(name, fn, sql)
        return fn

    return register


def all_plans() -> dict[str, Plan]:
    from trustframe.plans import (  # noqa: F401
        directory, drifting, evidence, facts, graph, money, pages, reconciling, registry_rules, storage,
    )

    return PLANS
