"""Where queries are registered beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixture import Atlas

QUERIES: dict[str, Callable[[Atlas], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, *ctes: str):
    """Registers the function under its name; `ctes` go before the SQL."""

    def register(f: Callable[[Atlas], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def unchecked(f: Callable[[Atlas], DataFrame]):
    """Registers a query that SQL can't express, or that needs a function which DuckDB lacks."""
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: what a comparison by value can hold."""
    kinds = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("long")}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])
