"""Registration of a query and its SQL twin with one shared output specification."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline.registry.views import CTES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The last bits of a sum depend on the order of addition. Query results (never library results)
# keep this many significant digits, and what is smaller than the noise of cancelled sums is 0.
# Exact decimal ties, which two engines round differently, are lifted by less than a digit counts.
SIGNIFICANT, NOISE, LIFT = 9, 1e-12, 1 + 3e-11
# Differences of much larger numbers keep decimals instead.
DECIMALS = 8


def significant(col: Column) -> Column:
    """A double to ``SIGNIFICANT`` digits."""
    shown = F.format_string(f"%.{SIGNIFICANT - 1}e", col * LIFT).cast("double")
    return F.when(F.abs(col) < NOISE, 0.0).when(col.isNotNull(), shown)


def significant_sql(col: str) -> str:
    return f"CASE WHEN abs({col}) < {NOISE} THEN CAST(0 AS DOUBLE) ELSE CAST(printf('%.{SIGNIFICANT - 1}e', CAST({col} AS DOUBLE) * {LIFT}) AS DOUBLE) END"


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple((c + ":s").split(":")[:2]) if ":" not in c else tuple(c.split(":")) for c in spec.split()]


def _spark_col(name: str, kind: str):
    col = F.col(f"`{name}`")
    if kind == "d":
        return significant(col.cast("double")).alias(name)
    if kind == "a":
        return F.round(col.cast("double") + 1e-12, DECIMALS).alias(name)
    return col.cast({"s": "string", "i": "int", "l": "bigint", "t": "string", "b": "boolean"}[kind]).alias(name)


def _sql_col(name: str, kind: str) -> str:
    col = f'"{name}"'
    if kind == "d":
        return f"{significant_sql(col)} AS {col}"
    if kind == "a":
        rounded = f"round(CAST({col} AS DOUBLE) + 1e-12, {DECIMALS})"
        return f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS {col}"
    kind = {"s": "VARCHAR", "i": "INTEGER", "l": "BIGINT", "t": "VARCHAR", "b": "BOOLEAN"}[kind]
    return f"CAST({col} AS {kind}) AS {col}"


def query(name: str, out: str, sql: str | None = None, views: str = ""):
    """``out`` lists the result columns as ``name:kind`` (s text, i int, l long, d double,
    a double that is a difference of larger ones, t date, b boolean); ``views`` names the shared table expressions the SQL reads."""
    cols = _parse(out)

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir)).select(*[_spark_col(n, k) for n, k in cols])

        QUERIES[name] = run
        if sql is not None:
            body = ", ".join(_sql_col(n, k) for n, k in cols)
            ctes = with_views(views)
            ORACLES[name] = f"{ctes}SELECT {body} FROM ({sql.strip()}) AS result_rows"
        return fn

    return wrap


def with_views(names: str) -> str:
    """WITH clause of the named views and everything they build on."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0].split():
            add(dep)
        order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1].strip()})" for n in order) + " " if order else ""
