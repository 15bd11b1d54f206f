"""Join shapes used by the reports.

Broadcast policy: a join side gets an explicit ``broadcast`` hint only when
its size has a proven bound -- a literal seed table or a page of at most
``MAX_PAGE_ROWS`` keys. Every other join is left to the planner: the static
``autoBroadcastJoinThreshold`` check on file statistics, and AQE's runtime
check on measured shuffle output, turn a sort-merge join into a broadcast
join only when the side really is small; skewed partitions of fact-to-fact
joins are split by AQE's skew-join handling.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_ROWS = 100  # L3 clamp: no page is larger, so a page of keys may be broadcast


def bounded(df: DataFrame) -> DataFrame:
    """Mark a side whose row count is bounded by construction (seed, page of keys)."""
    return F.broadcast(df)


HOT_KEYS = 10_000


def even_join(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join to ``lookup`` (one row a key; ``n_rows``: how many of the ``total`` rows hold it), hot keys apart.

    A key with more than a 10,000th of the rows is hot; at most 10,000 keys
    can be, so those are broadcast and their rows stay where they are. The
    others are shuffled in groups of at most that share. ``rows`` is read
    twice: pass a stored table."""
    hot = F.col("n_rows") * HOT_KEYS > total
    near = rows.join(bounded(lookup.where(hot).drop("n_rows")), key)
    far = rows.join(bounded(lookup.where(hot).select(key)), key, "left_anti").join(lookup.where(~hot).drop("n_rows"), key)
    return near.unionByName(far)


# Self join to the parent row --------------------------------------------
def with_parent(child: DataFrame, parent: DataFrame, parent_key: str, parent_fields: dict[str, str]) -> DataFrame:
    """Left-join each row to its parent row; ``parent_fields`` maps parent column -> output name."""
    p = parent.select(F.col("id").alias("__pid"),
                      *[F.col(src).alias(dst) for src, dst in parent_fields.items()])
    return child.join(p, child[parent_key] == p["__pid"], "left").drop("__pid")


# Role-playing double join -------------------------------------------------
def role_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, fields: dict[str, Column]) -> DataFrame:
    """Join ``dim`` once for ``fact_key``; ``fields`` are expressions over ``dim`` columns."""
    side = dim.select(F.col(dim_key).alias(f"__{fact_key}"), *[c.alias(n) for n, c in fields.items()])
    return fact.join(side, fact[fact_key] == side[f"__{fact_key}"], "inner").drop(f"__{fact_key}")


# Conditional left join ----------------------------------------------------
def left_join_where(left: DataFrame, right: DataFrame, on: Column | str | list[str],
                    right_pred: Column) -> DataFrame:
    """``LEFT JOIN r ON key AND r_pred``: the predicate filters ``right`` only."""
    return left.join(right.where(right_pred), on, "left")


# Lateral top-1 ------------------------------------------------------------
def first_per_key(df: DataFrame, key: str, order: list[str], value_cols: list[str],
                  where: Column | None = None) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple.

    The reference's ``LATERAL (… LIMIT 1)`` has no ORDER BY; the tie-break on
    ``order`` makes the choice deterministic. ``min_by`` is an ordinary
    aggregate, so it combines map-side and a hot key costs one partial row
    per task, never a collected group.
    """
    src = df.where(where) if where is not None else df
    ordering = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in value_cols])
    picked = src.groupBy(key).agg(F.min_by(payload, ordering).alias("__top"))
    return picked.select(key, *[F.col(f"__top.{c}").alias(c) for c in value_cols])


def primary_image(images: DataFrame) -> DataFrame:
    """product_id -> image_url of one primary image (lowest sort_order, id)."""
    return first_per_key(images, "product_id", ["sort_order", "id"], ["image_url"],
                         where=F.col("is_primary"))


# Bridge join ----------------------------------------------------------------
def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left JOIN bridge USING (left_key) JOIN right USING (right_key)``: one row per
    (left, right) pair of the many-to-many bridge table."""
    return left.join(bridge, left_key).join(right, right_key)


# J8, J9 ------------------------------------------------------------------------
def without(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def having(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    return left.join(right, on, "left_semi")


# J10 ---------------------------------------------------------------------------
def update_from(target: DataFrame, lookup: DataFrame, key: str, lookup_key: str,
                columns: dict[str, str], only_null: bool = False) -> DataFrame:
    """``UPDATE t SET col = l.src FROM l WHERE t.key = l.key`` as a left join.

    ``columns`` maps target column -> lookup column (a target column that does
    not exist yet counts as NULL). With ``only_null`` the target keeps its
    value unless it is NULL (back-fill).
    """
    lk = lookup.select(F.col(lookup_key).alias("__lk"),
                       *[F.col(src).alias(f"__new_{dst}") for dst, src in columns.items()])
    joined = target.join(lk, target[key] == lk["__lk"], "left")
    out = joined
    for dst in columns:
        new = F.col(f"__new_{dst}")
        old = F.col(dst) if dst in target.columns else F.lit(None)
        matched = F.col("__lk").isNotNull()
        val = F.coalesce(old, new) if only_null else F.when(matched, new).otherwise(old)
        out = out.withColumn(dst, val)
    return out.drop("__lk", *[f"__new_{d}" for d in columns])


# Child rows as an array -------------------------------------------------------
def child_array(parent: DataFrame, child: DataFrame, parent_key: str, child_fk: str,
                fields: Iterable[str], name: str, sort_by: list[str] | None = None,
                parent_bounded: bool = False, newest_first: bool = False) -> DataFrame:
    """Attach children as ``array<struct>`` sorted by ``sort_by`` (empty array when none).

    ``newest_first`` turns the order round (all of ``sort_by`` descending).

    Children are first collected per key (``collect_list`` aggregates
    partially in every map task, so even a parent with a third of all child
    rows has its rows gathered by many tasks; only the final concatenation is
    per key), then joined 1:1 to the parent: the join neither fans out nor
    concentrates a hot key. ``parent_key`` must be unique in ``parent``. For a
    bounded parent set (a page) the children are first cut down by a
    broadcast semi join on the page's keys, so the child table is scanned but
    never shuffled.
    """
    fields = list(fields)
    order = sort_by or fields
    ordered = order + [c for c in fields if c not in order]
    kids = child.select(F.col(child_fk).alias("__fk"), *[F.col(c).alias(f"__c_{c}") for c in ordered])
    if parent_bounded:
        kids = kids.join(bounded(parent.select(F.col(parent_key).alias("__fk"))), "__fk", "left_semi")
    elem = F.struct(*[F.col(f"__c_{c}").alias(c) for c in ordered])
    kept = F.array_sort(F.collect_list(elem))
    proj = F.transform(F.reverse(kept) if newest_first else kept, lambda s: F.struct(*[s[c].alias(c) for c in fields]))
    grouped = kids.groupBy("__fk").agg(proj.alias(name))
    out = parent.join(grouped, parent[parent_key] == grouped["__fk"], "left").drop("__fk")
    empty = F.array().cast(out.schema[name].dataType)
    return out.withColumn(name, F.coalesce(F.col(name), empty))


# Scalar subquery ----------------------------------------------------------------
def scalar(agg_df: DataFrame) -> Column:
    """Value of a one-row, one-column aggregate as a scalar subquery expression."""
    return agg_df.scalar()


# Equi join with a validity-range residual ------------------------------------------
def join_valid(left: DataFrame, right: DataFrame, left_key: str, right_key: str, as_of_col: Column,
               start: str, end: str, right_bounded: bool = False) -> DataFrame:
    r = bounded(right) if right_bounded else right
    cond = (left[left_key] == r[right_key]) & (r[start] <= as_of_col) & (r[end] >= as_of_col)
    return left.join(r, cond, "left")
