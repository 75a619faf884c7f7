"""Named queries over a driver folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiermill.session import tune
from tiermill.sources.bridge import Bronze

Plan = Callable[[Bronze], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` may use every named relation of ``oracle``."""

    def add(build: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, folder: str) -> DataFrame:
        return PLANS[name](Bronze(tune(spark), folder))

    call.__name__ = name
    return call
