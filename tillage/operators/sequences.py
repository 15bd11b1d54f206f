"""Ordered walks per key that stay spread when one key is hot.

``prior_values`` gives each row, for each expression, the value of that
expression on the latest *earlier* row of the same key (in ``order``) where it
is not NULL -- the building block of "previous value" (lag) and "state as of
the last event of kind X" rules.

A window partitioned by the key alone would sort a hot key's rows in one
task. Here rows are cut into time segments (``key``, time bucket): each
segment is scanned locally by a window partitioned on (key, segment), each
segment's last non-NULL value is an aggregate, and the value carried into a
segment is the last non-NULL value of the key's earlier segments (a window
over the small per-segment table). A key that holds a third of all rows is
thus spread over as many tasks as it has time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 00:00 of a wall-clock timestamp (no time zone involved)."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def prior_values(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column],
                 bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``exprs`` columns holding the latest earlier non-NULL value per key.

    ``order[0]`` must be a timestamp; it defines the segments
    (``bucket_seconds`` wide). Ties in ``order`` must be broken by the later
    columns (e.g. an id) so "earlier" is well defined.
    """
    seg = F.floor(wall_seconds(F.col(order[0])) / F.lit(bucket_seconds)).cast("bigint")
    base = df.withColumn("__seg", seg)
    for name, e in exprs.items():
        base = base.withColumn(f"__x_{name}", e)

    # 1. inside a segment: last non-NULL value strictly before the row
    w_local = (Window.partitionBy(*keys, "__seg").orderBy(*[F.col(c) for c in order])
               .rowsBetween(Window.unboundedPreceding, -1))
    local = base
    for name in exprs:
        local = local.withColumn(f"__l_{name}", F.last(F.col(f"__x_{name}"), ignorenulls=True).over(w_local))

    # 2. per segment: its last non-NULL value (aggregate; partial per task)
    ordering = F.struct(*[F.col(c) for c in order])
    seg_last = base.groupBy(*keys, "__seg").agg(*[
        F.max_by(F.col(f"__x_{n}"), F.when(F.col(f"__x_{n}").isNotNull(), ordering)).alias(f"__s_{n}")
        for n in exprs])

    # 3. carried into a segment: last non-NULL of the key's earlier segments
    w_seg = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = seg_last.select(*keys, "__seg", *[
        F.last(F.col(f"__s_{n}"), ignorenulls=True).over(w_seg).alias(f"__c_{n}") for n in exprs])

    out = local.join(carry, [*keys, "__seg"], "left")
    for name in exprs:
        out = out.withColumn(name, F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}")))
    drop = ["__seg"] + [f"__{p}_{n}" for n in exprs for p in ("x", "l", "c")]
    return out.drop(*drop)


def running_position(df: DataFrame, keys: list[str], order: list[Column], segment: Column,
                     name: str = "position") -> DataFrame:
    """1-based position of each row within its key in ``order``, without one task per key.

    ``segment`` must not decrease along ``order`` (it cuts a key's rows into
    consecutive runs, e.g. an id range). Each segment is numbered locally by a
    window on (key, segment); the rows of a key's earlier segments are
    counted per segment and carried in by a window over the small per-segment
    table.
    """
    base = df.withColumn("__seg", segment)
    local = base.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__seg").orderBy(*order)))
    counts = base.groupBy(*keys, "__seg").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, "__seg", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__carry"))
    out = local.join(carry, [*keys, "__seg"], "left")
    return out.withColumn(name, (F.col("__carry") + F.col("__rn")).cast("bigint")).drop("__seg", "__rn", "__carry")
