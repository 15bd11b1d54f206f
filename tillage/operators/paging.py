"""Ordering, top-k, pages and page metadata.

``orderBy(...).limit(k)`` and ``.offset(n).limit(m)`` plan as a
TakeOrderedAndProject: every task keeps its own top ``n+m`` rows and only
those reach the final merge, so a page never needs a global sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.operators.filters import leading_number


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# PostgreSQL default NULL placement, stated explicitly -------------------------
def pg_asc(x: Column | str) -> Column:
    """PG ``ASC``: NULLs last."""
    return _c(x).asc_nulls_last()


def pg_desc(x: Column | str) -> Column:
    """PG ``DESC``: NULLs first."""
    return _c(x).desc_nulls_first()


# L3 ---------------------------------------------------------------------------
def clamp_page(page: Any = 1, limit: Any = 20, max_limit: int = 100) -> tuple[int, int]:
    """``page = max(1, (int)page)``, ``limit = min(max, max(1, (int)limit))``."""
    def as_int(v: Any, default: int) -> int:
        return default if v is None else int(leading_number(v))
    p = max(1, as_int(page, 1))
    lim = min(max_limit, max(1, as_int(limit, 20)))
    return p, lim


# L4 ---------------------------------------------------------------------------
def whitelisted_sort(name: str | None, direction: str | None, allowed: dict[str, str],
                     default: str) -> Column:
    """Sort column from a whitelist; direction is ``asc`` only when asked exactly."""
    col = allowed.get(name or "", allowed[default])
    return pg_asc(col) if direction == "asc" else pg_desc(col)


# L1 ---------------------------------------------------------------------------
def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


# L2 ---------------------------------------------------------------------------
@dataclass(frozen=True)
class PageMeta:
    page: int
    limit: int

    def pages(self, total: int) -> int:
        return int(math.ceil(total / self.limit)) if self.limit else 0


def page(df: DataFrame, order: list[Column], page_no: int, limit: int) -> DataFrame:
    """Rows ``(page-1)*limit .. page*limit`` in ``order`` (give a unique last key)."""
    return df.orderBy(*order).offset((page_no - 1) * limit).limit(limit)


def keyset_page(df: DataFrame, keys: list[tuple[str, str]], after: tuple | None, limit: int) -> DataFrame:
    """Next page after the last row seen, by its sort-key values (keyset paging).

    ``keys`` are ``(column, "asc" | "desc")`` pairs ending in a unique column;
    ``after`` holds the previous page's last values (None for the first page).
    Unlike OFFSET, the cost does not grow with the page number: the filter
    reaches the scan and each task keeps only ``limit`` rows. Key columns
    must not be NULL.
    """
    if after is not None:
        pred = None
        for i in range(len(keys) - 1, -1, -1):
            col, direction = keys[i]
            step = F.col(col) > F.lit(after[i]) if direction == "asc" else F.col(col) < F.lit(after[i])
            pred = step if pred is None else step | ((F.col(col) == F.lit(after[i])) & pred)
        df = df.where(pred)
    order = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in keys]
    return df.orderBy(*order).limit(limit)


def materialized_page(df: DataFrame, order: list[Column], page_no: int, limit: int) -> DataFrame:
    """:func:`page`, written once to the shared checkpoint folder.

    A page is read several times by the enrichment that follows (address,
    child rows, final projection); without this each read would re-run the
    whole filtered join and top-k over the full tables. The page holds at
    most ``limit`` (<= 100) rows, so the write is tiny.
    """
    from tillage.session import cut_lineage
    return cut_lineage(page(df, order, page_no, limit))


def page_meta(total: DataFrame, page_no: int, limit: int, total_col: str = "total") -> DataFrame:
    """``{total, page, limit, pages = ceil(total / limit)}`` as a one-row DataFrame."""
    t = F.col(total_col)
    return total.select(t.cast("bigint").alias("total"), F.lit(page_no).alias("page"),
                        F.lit(limit).alias("limit"),
                        F.ceil(t / F.lit(limit)).cast("bigint").alias("pages"))


# per-key top-N and L6 ----------------------------------------------------------------
def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    ``row_number() <= n`` is planned with a per-partition group limit before
    the shuffle (WindowGroupLimit), so a hot key ships at most ``n`` rows per
    task to the final window.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """The newest row per key (``ORDER BY ts DESC LIMIT 1``), tie broken by ``tie``."""
    payload = F.struct(*[F.col(c) for c in cols])
    picked = df.groupBy(key).agg(F.max_by(payload, F.struct(F.col(ts), F.col(tie))).alias("__last"))
    return picked.select(key, *[F.col(f"__last.{c}").alias(c) for c in cols])
