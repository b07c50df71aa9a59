"""The list of queries: a name, a plan, and SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanlake.plans.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a plan f(views) -> DataFrame. In `sql`, names of derived views may
    be used, and {r(x)} stands for rounding as in the plan."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__name__, QUERIES[name].__doc__ = name, f.__doc__
        if sql:
            ORACLES[name] = oracle(sql, recursive)
        return f

    return register


def oracle(sql: str, recursive: bool = False) -> str:
    sql = re.sub(r"R4\(((?:[^()]|\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\))*)\)", r"(round((\1) + 1e-9, 4) + 0.0::DOUBLE)", sql)
    used = [f"{k} AS ({v})" for k, v in SQL.items() if re.search(rf"\b{k}\b", sql)]
    head = re.match(r"\s*WITH\s+", sql)
    if head:
        used.append(sql[head.end() :].lstrip())
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(used)
    return ("WITH " + ", ".join(used) + " " if used else "") + sql.lstrip()
