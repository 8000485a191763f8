"""Query registry: a Spark plan, its output columns, and the equivalent SQL.

``spec`` lists the output columns of both sides: ``name`` is text, ``name:d`` a date
(shown as text), ``name:i`` a whole number, ``name:f6`` a double rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str, bool]] = {}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) if ":" in part else (part, "s") for part in spec.split()]


def cte(name: str, sql: str, *needs: str, recursive: bool = False) -> None:
    CTES[name] = (needs, sql, recursive)


def _resolve(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _resolve(CTES[n][0], seen)
            seen.append(n)
    return seen


def with_ctes(needs: tuple[str, ...], final: str) -> str:
    order = _resolve(needs, [])
    parts = [f"{n} AS {'' if CTES[n][2] else 'MATERIALIZED '}({CTES[n][1]})" for n in order]
    return f"WITH RECURSIVE {', '.join([*parts, f'result AS ({final})'])} "


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "s":
        return f"cast({q} AS varchar) AS {q}"
    if kind == "d":
        return f"strftime({q}, '%Y-%m-%d') AS {q}"
    if kind == "t":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}"
    if kind == "i":
        return f"cast({q} AS bigint) AS {q}"
    return f"round(cast({q} AS double), {kind[1:]}) + 0.0E0 AS {q}"


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "i":
        return c.cast("long").alias(name)
    return (F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def query(name: str, spec: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a plan function of a Market under ``name``."""
    columns = _parse(spec)

    def register(fn: Callable[[Market], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Market(spark, folder)).select(*[_spark_column(n, k) for n, k in columns])

        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = run
        if sql is not None:
            select = ", ".join(_sql_column(n, k) for n, k in columns)
            ORACLES[name] = with_ctes(needs, sql) + f"SELECT {select} FROM result"
        return fn

    return register


def columns(names: list[str] | tuple[str, ...], kind: str) -> str:
    return " ".join(f"{n}:{kind}" for n in names)
