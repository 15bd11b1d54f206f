"""Predicate builders. Every function returns a ``Column`` (or a
filtered DataFrame) built from Spark expressions, so Catalyst can push the
comparison into the Parquet scan where the column is a stored one.
"""

from __future__ import annotations

import re
import datetime as dt
from decimal import Decimal
from functools import reduce
from typing import Any, Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import ntz

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def php_truthy(value: Any) -> bool:
    """PHP truthiness of a request parameter: '', '0', 0, None, [] are false."""
    if value is None or value is False:
        return False
    if isinstance(value, str):
        return value not in ("", "0")
    if isinstance(value, (int, float)):
        return value != 0
    if isinstance(value, (list, tuple, dict)):
        return len(value) > 0
    return True


# F1 -----------------------------------------------------------------------
def optional(value: Any, make: Callable[[Any], Column]) -> Column | None:
    """Predicate only when the parameter is truthy (PHP rule)."""
    return make(value) if php_truthy(value) else None


def conjunction(preds: Iterable[Column | None]) -> Column:
    """AND of the given predicates; ``None`` entries are skipped; empty -> TRUE."""
    kept = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else F.lit(True)


def where_all(df: DataFrame, preds: Iterable[Column | None]) -> DataFrame:
    kept = [p for p in preds if p is not None]
    return df.where(conjunction(kept)) if kept else df


# F2 -----------------------------------------------------------------------
def equals(col: ColumnLike, value: Any) -> Column:
    return _c(col) == F.lit(value)


# F3 -----------------------------------------------------------------------
def contains_ci(cols: Iterable[ColumnLike], text: str) -> Column:
    """``col ILIKE '%text%'`` OR-ed over columns; ``%`` and ``_`` in ``text`` stay wildcards.

    A backslash escapes ``%``, ``_`` and itself; before anything else it is text."""
    pattern = "%" + re.sub(r"\\([%_\\]?)", lambda m: m[0] if m[1] else r"\\", text) + "%"
    return reduce(lambda a, b: a | b, [_c(c).ilike(pattern) for c in cols])


def leading_number(value: Any) -> Decimal:
    """PHP ``(float)`` of a parameter: the leading decimal number of its text ('12abc' -> 12), else 0."""
    m = re.match(r"\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", str(value))
    # Plain notation, so that the literal is a decimal and a decimal column isn't cast.
    return Decimal(format(Decimal(m[1]), "f")) if m else Decimal(0)


# F5, F6 -------------------------------------------------------------------
def price_range(col: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column | None:
    preds = []
    if php_truthy(lo):
        preds.append(_c(col) >= F.lit(leading_number(lo)))
    if php_truthy(hi):
        preds.append(_c(col) <= F.lit(leading_number(hi)))
    return conjunction(preds) if preds else None


def less_than(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) < _c(b)


# Time --------------------------------------------------------------
def _date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def on_day(ts: ColumnLike, day: str | dt.date) -> Column:
    """``DATE(ts) = day`` rewritten as a half-open range (keeps scan pushdown)."""
    d = _date(day)
    start = dt.datetime.combine(d, dt.time())
    return (_c(ts) >= ntz(start)) & (_c(ts) < ntz(start + dt.timedelta(days=1)))


def between_to_next_midnight(ts: ColumnLike, start: str | dt.date, end: str | dt.date) -> Column:
    """``ts BETWEEN start AND end::date + 1``: the next day's 00:00:00 is included."""
    lo = dt.datetime.combine(_date(start), dt.time())
    hi = dt.datetime.combine(_date(end) + dt.timedelta(days=1), dt.time())
    return (_c(ts) >= ntz(lo)) & (_c(ts) <= ntz(hi))


def months_before(as_of: dt.datetime, months: int) -> dt.datetime:
    """``as_of - INTERVAL 'n months'`` with PG's end-of-month clamp."""
    y, m = divmod(as_of.year * 12 + (as_of.month - 1) - months, 12)
    m += 1
    last = (dt.date(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(days=1)).day
    return as_of.replace(year=y, month=m, day=min(as_of.day, last))


def trailing(ts: ColumnLike, as_of: dt.datetime, *, months: int = 0, days: int = 0) -> Column:
    """``ts >= as_of - INTERVAL`` (months or days)."""
    start = months_before(as_of, months) if months else as_of
    start = start - dt.timedelta(days=days)
    return _c(ts) >= ntz(start)


# expiry bands ----------------------------------------------------------
def _ts(as_of: dt.datetime) -> Column:
    return ntz(as_of)


def expiry_band_stock(expiry: ColumnLike, band: str, as_of: dt.datetime) -> Column | None:
    """Stock list filter: expired / expiring_soon (0-30 days) / good (incl. NULL)."""
    e = _c(expiry).cast("timestamp_ntz")
    now, soon = _ts(as_of), ntz(as_of + dt.timedelta(days=30))
    if band == "expired":
        return e < now
    if band == "expiring_soon":
        return e.between(now, soon)
    if band == "good":
        return e.isNull() | (e > soon)
    return None


def expiry_band_report(expiry: ColumnLike, band: str, as_of: dt.datetime) -> Column | None:
    """Expiry report filter: expired / expiring_7 / expiring_30 (covers the 7-day band too)."""
    e = _c(expiry).cast("timestamp_ntz")
    now = _ts(as_of)
    if band == "expired":
        return e < now
    if band == "expiring_7":
        return e.between(now, ntz(as_of + dt.timedelta(days=7)))
    if band == "expiring_30":
        return e.between(now, ntz(as_of + dt.timedelta(days=30)))
    return None


# F11 ----------------------------------------------------------------------
def in_values(col: ColumnLike, values: Iterable[Any]) -> Column:
    return _c(col).isin(list(values))


def in_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (semi join; no duplicates added)."""
    return df.join(keys, on, "left_semi")


# F12-F15 --------------------------------------------------------------------
def category_or_parent(category_col: ColumnLike, parent_col: ColumnLike, category_id: Any) -> Column:
    return (_c(category_col) == F.lit(category_id)) | (_c(parent_col) == F.lit(category_id))


def valid_at(start: ColumnLike, end: ColumnLike, as_of: dt.datetime) -> Column:
    return (_c(start) <= _ts(as_of)) & (_c(end) >= _ts(as_of))


def is_null(col: ColumnLike) -> Column:
    return _c(col).isNull()


def not_null(col: ColumnLike) -> Column:
    return _c(col).isNotNull()
