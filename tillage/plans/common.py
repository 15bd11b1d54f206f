"""Shared parameters and helpers of the report plans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.sources.fixtures import Catalog

# Fixed clock of the test data (FIXTURES.md): NOW() for orders and stock.
AS_OF = dt.datetime(2001, 8, 1, 6, 0, 0)


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[Catalog], DataFrame]
    sql: str | None  # DuckDB oracle; None when not SQL-expressible


def digest(arr: Column | str, fields: list[str], sep: str = ";") -> Column:
    """Order-free text form of an array of structs: sorted 'f1|f2|…' entries joined by ``sep``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    entries = F.transform(a, lambda s: F.concat_ws("|", *[s[f].cast("string") for f in fields]))
    return F.array_join(F.array_sort(entries), sep)


def sql_digest(expr: str) -> str:
    """DuckDB twin of :func:`digest` as an aggregate over child rows."""
    return f"coalesce(string_agg({expr}, ';' ORDER BY {expr}), '')"


def ts_lit(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'"
