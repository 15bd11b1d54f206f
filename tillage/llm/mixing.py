"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. A source whose target is a
whole number of passes and a rest takes every document that often; the rest is
fitted on the counts: first the same share of every size, then a bounded
knapsack over what is left of the counts closes the gap (largest sizes first
while the gap is over ``GAP`` words, then dynamic programming, exact where any
subset is). The plan says how many documents of each size to take; which ones
is settled by a seeded hash of the document, by rank within source and size.
Ranks are taken within hash buckets whose totals are summed up first, so a
large group of one source and size is never ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
HASH_BUCKETS = 256
GAP = 1 << 16
SIZE_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(SIZE_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): shares of ``share`` times all sizes by weight, at most ``most`` times the source.

    Sources by code point, null last, get the weights in turn. What is over a
    source's limit is shared again by weight until none is above; that is the
    level at which min(limit, level * weight) uses up the budget, found from
    running sums over the sources in order of limit / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", given).withColumn("limit", F.col("source_size") * F.lit(most))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    # The first source in that order which its own level does not fill.
    below = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("place", "level"))
    return s.withColumn("found", F.min(below).over(Window.partitionBy())["level"]).select(
        "source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("found") * F.col("weight"), F.col("limit"))).alias("target"))


def fit_counts(size: np.ndarray, count: np.ndarray, want: int) -> np.ndarray:
    """How many of ``count`` documents of each size to take so that the words come as near ``want`` as can be found.

    The fit is exact (no subset is nearer) where the gap left by the equal
    shares can be closed by what is left of the counts within ``GAP`` words.
    """
    take = np.zeros(len(size), np.int64)
    total = int((size * count).sum())
    if want <= 0 or total == 0:
        return take
    if want >= total:
        return count.copy()
    take = (count.astype(float) * (want / total)).astype(np.int64)
    gap = want - int((take * size).sum())
    order = np.argsort(-size, kind="stable")
    for i in order:
        if gap <= GAP:
            break
        n = min(int(count[i] - take[i]), (gap - GAP) // int(size[i]) if size[i] else 0)
        take[i] += n
        gap -= n * int(size[i])
    # Sums reachable from the rest of the counts; for each, the piece that reached it first.
    top = gap + int(size.max())
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    first = np.full(top + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for i in order:
        left, n = int(count[i] - take[i]), 1
        w = int(size[i])
        left = min(left, top // w) if w else 0
        while left > 0 and not reach[gap]:
            n = min(n, left)
            step = n * w
            if step <= top:
                new = np.flatnonzero(reach[:top + 1 - step] & ~reach[step:]) + step
                reach[new] = True
                first[new] = len(pieces)
                pieces.append((int(i), n))
            left -= n
            n *= 2
        if reach[gap]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - gap))])
    while at:
        i, n = pieces[first[at]]
        take[i] += n
        at -= n * int(size[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and extra documents by size, for one source's counts."""
    pdf = pdf.sort_values("size")
    size, count = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int((size * count).sum()), float(pdf["target"].iloc[0])
    passes = int(target // total) if total else 0
    extra = fit_counts(size, count, int(round(target - passes * total))) if total else np.zeros(len(size), np.int64)
    return pd.DataFrame({"source": pdf["source"], "size": size, "passes": passes, "extra": extra})


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 1,
        share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size`` (long), ``target`` (double), ``copies``, ``taken`` (long).

    ``taken`` is the words the mix takes of the row: ``copies`` times its
    size; copies are 0 to ``most``. Null sources are one source. Null texts
    have size 0 and are taken as their size costs nothing: with their
    source's whole passes. Rows that repeat (same id, source and size) share
    a rank's chance and get as many copies together as the plan says. Reruns
    agree. Input columns of these names are replaced. Empty: empty.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in made]
    base = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)],
                       F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string")).alias("draw"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(HASH_BUCKETS)))
    fine = base.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    coarse = fine.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(coarse.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights)
    same_source = F.col("c.source").eqNullSafe(F.col("g.source"))
    counted = coarse.alias("c").join(goal.alias("g"), same_source).select("c.source", "c.size", "c.n", "g.target")
    plan = counted.groupBy("source").applyInPandas(_plan, "source string, size long, passes long, extra long")

    # Documents before a bucket, of the same source and size: at most HASH_BUCKETS rows each.
    carry = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ahead = (fine.withColumn("ahead", F.coalesce(carry, F.lit(0))).alias("f")
             .join(plan.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")) & (F.col("f.size") == F.col("p.size")))
             .join(goal.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")))
             .select("f.source", "f.size", "f.bucket", "f.ahead", "p.passes", "p.extra", "g.source_size", "g.target"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw"))
    out = base.withColumn("rank", rank).alias("b").join(
        ahead.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")) & (F.col("b.size") == F.col("a.size"))
        & (F.col("b.bucket") == F.col("a.bucket")))
    copies = F.col("a.passes") + F.when(F.col("a.ahead") + F.col("b.rank") <= F.col("a.extra"), 1).otherwise(0)
    return (out.withColumn("copies", copies.cast("long"))
            .select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], F.col("b.size").alias("size"),
                    F.col("a.source_size").cast("long").alias("source_size"), F.col("a.target").alias("target"), "copies",
                    (F.col("copies") * F.col("b.size")).alias("taken")))
