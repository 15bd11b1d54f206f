"""Aggregate expressions. All are built-in aggregates, so each runs as
partial (map-side) aggregation -> shuffle on the group key -> final merge;
a hot key costs one partial row per task, not one task for the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def count_where(pred: Column) -> Column:
    """A1: ``COUNT(*) FILTER (WHERE pred)``."""
    return F.count_if(pred)


def sum_or_zero(x: Column | str, out_type: str = MONEY) -> Column:
    """A2: ``COALESCE(SUM(x), 0)`` with one explicit output type."""
    col = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(col), F.lit(0)).cast(out_type)


def sum_when(x: Column | str, pred: Column, out_type: str = MONEY) -> Column:
    """A3: ``SUM(CASE WHEN pred THEN x ELSE 0 END)``."""
    col = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(F.when(pred, col).otherwise(F.lit(0))), F.lit(0)).cast(out_type)


def distinct_count(x: Column | str) -> Column:
    """A4: exact ``COUNT(DISTINCT x)``."""
    return F.count_distinct(F.col(x) if isinstance(x, str) else x)


def avg_or_zero(x: Column | str) -> Column:
    """``COALESCE(AVG(x), 0)`` as double."""
    col = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.avg(col), F.lit(0.0))


def count_children(parent: DataFrame, child: DataFrame, parent_key: str, child_fk: str,
                   name: str) -> DataFrame:
    """Number of child rows per parent, zero kept (``COUNT(child.id)`` over a left join).

    Children are counted per key before the join, so the join never fans out.
    """
    counts = child.groupBy(F.col(child_fk).alias("__fk")).agg(F.count(F.lit(1)).alias(name))
    out = parent.join(counts, parent[parent_key] == counts["__fk"], "left").drop("__fk")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def rows_to_map(df: DataFrame, key: str, value: str, group: list[str] | None = None,
                name: str = "map") -> DataFrame:
    """``{key: value}`` per group (or one map when ``group`` is empty).

    Entries are sorted by key so the map is deterministic. ``key`` must be
    unique within a group (it is a primary key in every use); a repeated key
    fails the job under Spark's default map-key policy rather than silently
    picking one value.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    agg = F.map_from_entries(entries).alias(name)
    if group:
        return df.groupBy(*group).agg(agg)
    return df.agg(agg)
