"""M13 data-quality rules and M15 referential checks.

A rule is a column-level predicate that is TRUE for a valid value. All rules
of one table are evaluated in a single aggregation pass (``count_if`` per
rule), then the per-rule counts are unpivoted into rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Validator patterns (mobile: Indian 10-digit, UUID 8-4-4-4-12 hex).
MOBILE_PATTERN = r"^[6-9][0-9]{9}$"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL_PATTERN = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    valid: Column  # TRUE when the value passes


def required(col: str) -> Rule:
    """Set and not the empty string (PHP ``isset && !== ''``)."""
    c = F.col(col)
    return Rule(f"{col}_required", col, c.isNotNull() & (c.cast("string") != ""))


def mobile(col: str) -> Rule:
    c = F.col(col)
    return Rule(f"{col}_mobile", col, c.isNotNull() & c.rlike(MOBILE_PATTERN))


def email(col: str) -> Rule:
    c = F.col(col)
    return Rule(f"{col}_email", col, c.isNotNull() & c.rlike(EMAIL_PATTERN))


def uuid(col: str) -> Rule:
    c = F.col(col)
    return Rule(f"{col}_uuid", col, c.isNotNull() & c.rlike(UUID_PATTERN))


def one_of(col: str, values: Iterable[str]) -> Rule:
    """SQL CHECK (col IN …): NULL passes, as in the database."""
    c = F.col(col)
    return Rule(f"{col}_in", col, c.isNull() | c.isin(list(values)))


def between(col: str, lo, hi) -> Rule:
    c = F.col(col)
    return Rule(f"{col}_range", col, c.isNull() | c.between(lo, hi))


def violations(table: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(table_name, rule, column_name, violations, checked_rows) for each rule, one scan."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(~F.coalesce(r.valid, F.lit(False))).alias(f"__r{i}") for i, r in enumerate(rules)]
    counts = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column_name"),
                                 F.col(f"__r{i}").alias("violations")) for i, r in enumerate(rules)])
    return counts.select(F.lit(table).alias("table_name"), F.explode(entries).alias("e"), "__rows").select(
        "table_name", "e.rule", "e.column_name", "e.violations", F.col("__rows").alias("checked_rows"))


def quality_report(checks: dict[str, tuple[DataFrame, list[Rule]]]) -> DataFrame:
    parts = [violations(t, df, rules) for t, (df, rules) in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with ``failed_rules`` (empty array = clean); split with ``size(failed_rules) = 0``."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(r.valid, F.lit(False)), F.lit(r.name)) for r in rules]),
                      lambda x: x.isNotNull())
    return df.withColumn("failed_rules", failed)


# M15 -----------------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row."""
    keys = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def orphan_report(relations: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(relation, orphan_rows) for each ``name -> (child, parent, fk)``."""
    parts = [orphans(ch, pa, fk).agg(F.count(F.lit(1)).alias("orphan_rows"))
             .select(F.lit(name).alias("relation"), "orphan_rows") for name, (ch, pa, fk) in relations.items()]
    return reduce(DataFrame.unionByName, parts)
