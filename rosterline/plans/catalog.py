"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def plan(check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query under its function name, with equivalent SQL where there is one."""

    def register(function: Plan) -> Plan:
        PLANS[function.__name__] = function
        if check is not None:
            CHECKS[function.__name__] = check
        return function

    return register
