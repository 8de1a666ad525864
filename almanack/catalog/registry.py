"""Register of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanack.catalog.carriers import CTES, Carriers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(carriers) -> DataFrame``; ``uses`` names the shared CTEs of its SQL."""

    def wrap(fn: Callable[[Carriers], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Carriers(spark, sf_dir))
        if sql is not None:
            wanted = _closure(uses.split())
            head = ", ".join(f"{c} AS ({CTES[c]})" for c in wanted)
            body = sql.strip()
            if not head:
                ORACLES[name] = body
            elif body[:5].lower() == "with ":
                ORACLES[name] = f"WITH {head}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {head} {body}"
        return fn

    return wrap


NEEDS = {"runs": ["ev"], "views": ["ev"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for dep in [*NEEDS.get(n, []), n]:
            if dep not in out:
                out.append(dep)
    return out
