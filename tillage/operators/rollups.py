"""Stored daily partials (A6, F9) and distinct-count bitmaps (A4) that a refresh only adds to.

A refresh reads one batch of whole orders (of new days, or late ones of old
days), aggregates it per day and writes the partials to a folder of its own,
``batch=<name>/month=<yyyymm>``: nothing stored is read or rewritten, and a
repeated refresh replaces its own folder, so it counts once. Reports read the
months they need and merge the batches' partials: sums add, bitmaps are or-ed.

A day's rows at its midnight are kept apart (``midnight``), as the reports'
date ranges take in the midnight that ends them. A trailing window that begins
within a day takes that day's rest from the orders themselves, so every
report equals the direct one exactly.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.exprs import to_char, trunc_ts
from tillage.operators import filters as flt
from tillage.operators.aggregates import MONEY, sum_or_zero
from tillage.operators.paging import top_k

PARTITIONS = "batch string, month int"
PAID_DAYS = "day date, midnight boolean, revenue decimal(38,2), orders bigint"
PRODUCT_DAYS = "day date, midnight boolean, product_id bigint, units bigint, orders bigint, amount decimal(38,2)"
SALES_IDS = "day date, midnight boolean, salesman_id bigint, kind string, word bigint, bits bigint"


def _slot(ts: str = "created_at") -> list[Column]:
    day = F.to_date(ts)
    return [day.alias("day"), (F.col(ts) == day.cast("timestamp_ntz")).alias("midnight")]


def _month(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def _word(i: Column) -> Column:
    """The number of the bitmap word of 64 ids that holds id ``i``."""
    return F.shiftright(i, 6)


def _bit(i: Column) -> Column:
    """Id ``i``'s bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def _in_days(start: dt.date, end: dt.date | None = None) -> Column:
    """Slots from ``start`` to ``end``, whose closing midnight counts, with the months to prune folders by."""
    rows = (F.col("day") >= F.lit(start)) & (F.col("month") >= F.lit(start.year * 100 + start.month))
    if end is not None:
        after = end + dt.timedelta(days=1)
        rows = rows & ((F.col("day") <= F.lit(end)) | ((F.col("day") == F.lit(after)) & F.col("midnight")))
        rows = rows & (F.col("month") <= F.lit(after.year * 100 + after.month))
    return rows


@dataclass(frozen=True)
class DailyRollups:
    """Partials under ``path``: paid orders per day, their lines per day and product, bitmaps of salesmen's orders and customers.

    Orders without ``created_at`` are in no partial, as no date range takes
    them in (``revenue_summary`` over all days adds them from the orders).
    Every order comes whole, in one batch; rows of one order in two batches
    would count twice in sums (not in bitmaps).
    """

    path: str

    def _write(self, df: DataFrame, table: str, batch: str, *keys: str) -> None:
        # Even ranges of month, day and keys: a task writes to the folders of its months only (else each task to each month's),
        # a hot day is dealt to many; sorted, so that row groups skip by day.
        df = df.withColumn("month", _month(F.col("day"))).repartitionByRange("month", "day", *keys)
        df.sortWithinPartitions("month", "day").write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/{table}/batch={batch}")

    def _read(self, spark: SparkSession, table: str, columns: str) -> DataFrame:
        return spark.read.schema(f"{columns}, {PARTITIONS}").parquet(f"{self.path}/{table}")

    def refresh(self, batch: str, orders: DataFrame, order_items: DataFrame) -> "DailyRollups":
        """Add the partials of one batch of orders and their lines (lines of other orders are left out)."""
        paid = orders.where((F.col("payment_status") == "paid") & F.col("created_at").isNotNull()).select("id", "final_amount", *_slot())
        days = paid.groupBy("day", "midnight").agg(F.sum("final_amount").cast(MONEY).alias("revenue"), F.count(F.lit(1)).alias("orders"))
        self._write(days, "paid_days", batch)
        lines = order_items.select("order_id", "product_id", "quantity", "total").join(
            paid.select(F.col("id").alias("order_id"), "day", "midnight"), "order_id")
        # Lines of an order are one row a product first: then orders are counted without a distinct.
        per_order = lines.groupBy("order_id", "product_id", "day", "midnight").agg(
            F.sum("quantity").cast("bigint").alias("units"), F.sum("total").cast(MONEY).alias("amount"))
        products = per_order.groupBy("day", "midnight", "product_id").agg(
            F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders"), F.sum("amount").cast(MONEY).alias("amount"))
        self._write(products, "product_days", batch, "product_id")
        return self

    def refresh_salesmen(self, batch: str, salesman_orders: DataFrame, orders: DataFrame) -> "DailyRollups":
        """Add one batch's bitmaps: per day, salesman and word of 64 ids one bit an order or customer.

        A row is one word, so there are at most as many rows as ids seen, however far apart a day's ids lie."""
        o = orders.where(F.col("created_at").isNotNull()).select(F.col("id").alias("order_id"), "customer_id", *_slot())
        ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("bigint").alias("id")) for k in ("order", "customer")])
        seen = (salesman_orders.select("order_id", "salesman_id").join(o, "order_id")
                .select("day", "midnight", "salesman_id", F.explode(ids).alias("x")).select("day", "midnight", "salesman_id", "x.*")
                .where(F.col("id").isNotNull()))
        bits = seen.groupBy("day", "midnight", "salesman_id", "kind", _word(F.col("id")).alias("word")).agg(F.bit_or(_bit(F.col("id"))).alias("bits"))
        self._write(bits, "sales_ids", batch, "salesman_id", "word")
        return self

    # Reports --------------------------------------------------------------------------
    def _trailing(self, orders: DataFrame, as_of: dt.datetime, months: int, days: int) -> DataFrame:
        """(day, revenue, orders) of paid orders from ``as_of`` less the interval on: whole days stored, the first day's rest counted."""
        start = (flt.months_before(as_of, months) if months else as_of) - dt.timedelta(days=days)
        whole = start.date() if start == dt.datetime.combine(start.date(), dt.time()) else start.date() + dt.timedelta(days=1)
        stored = self._read(orders.sparkSession, "paid_days", PAID_DAYS).where(_in_days(whole)).select("day", "revenue", "orders")
        rest = orders.where((F.col("payment_status") == "paid") & (F.col("created_at") >= flt.ntz(start)) &
                            (F.col("created_at") < flt.ntz(dt.datetime.combine(whole, dt.time()))))
        rest = rest.groupBy(F.to_date("created_at").alias("day")).agg(
            F.sum("final_amount").cast(MONEY).alias("revenue"), F.count(F.lit(1)).alias("orders"))
        return stored.unionByName(rest).withColumn("ts", F.col("day").cast("timestamp_ntz"))

    def monthly_revenue(self, orders: DataFrame, as_of: dt.datetime, months: int = 6) -> DataFrame:
        """R03 from the partials."""
        g = self._trailing(orders, as_of, months, 0).groupBy(trunc_ts("ts", "month").alias("month_start"))
        return (g.agg(F.sum("revenue").cast(MONEY).alias("revenue"), F.sum("orders").alias("orders"))
                .select(to_char("month_start", "Mon YYYY").alias("month"), "revenue", "orders", "month_start").orderBy("month_start"))

    def monthly_sales(self, orders: DataFrame, as_of: dt.datetime, months: int = 6) -> DataFrame:
        """R10 from the partials."""
        g = self._trailing(orders, as_of, months, 0).groupBy(to_char("ts", "Mon").alias("m"), to_char("ts", "YYYY-MM").alias("ym"))
        return g.agg(F.sum("revenue").cast(MONEY).alias("rev"), F.sum("orders").alias("orders")).orderBy("ym")

    def daily_sales(self, orders: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
        """R11 from the partials."""
        g = self._trailing(orders, as_of, 0, days).groupBy(trunc_ts("ts", "day").alias("day"), to_char("ts", "Dy").alias("d"))
        return g.agg(F.sum("revenue").cast(MONEY).alias("rev"), F.sum("orders").alias("orders")).orderBy("day")

    def revenue_summary(self, orders: DataFrame) -> DataFrame:
        """R13 from the partials; paid orders without a date are counted from the orders."""
        undated = orders.where((F.col("payment_status") == "paid") & F.col("created_at").isNull()).agg(
            sum_or_zero("final_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        stored = self._read(orders.sparkSession, "paid_days", PAID_DAYS).select("revenue", "orders")
        return stored.unionByName(undated).agg(sum_or_zero("revenue").alias("total_revenue"), F.sum("orders").alias("total_orders"))

    def fast_moving(self, products: DataFrame, categories: DataFrame, date_from: dt.date, date_to: dt.date, k: int = 50) -> DataFrame:
        """R18 from the partials."""
        per = (self._read(products.sparkSession, "product_days", PRODUCT_DAYS).where(_in_days(date_from, date_to)).groupBy("product_id")
               .agg(F.sum("units").alias("units_sold"), F.sum("orders").alias("order_count"), F.sum("amount").cast(MONEY).alias("sales_amount")))
        pr = products.select(F.col("id").alias("product_id"), "name", F.col("stock_qty").alias("current_stock"), F.col("category_id").alias("__cat"))
        cat = categories.select(F.col("id").alias("__cid"), F.col("name").alias("category_name"))
        j = per.join(pr, "product_id").join(cat, F.col("__cat") == F.col("__cid"), "left")
        top = top_k(j, [F.col("units_sold").desc(), F.col("product_id").asc()], k)
        return top.select(F.col("product_id").alias("id"), "name", "category_name", "units_sold", "order_count", "sales_amount", "current_stock")

    def distinct_sales(self, spark: SparkSession, ranges: list[tuple[dt.date, dt.date]], by_salesman: bool = False) -> DataFrame:
        """R36's exact distinct orders and customers for each of ``ranges`` (from, to + 1 day), all from one read.

        A word's bits are or-ed over days, batches and salesmen, then
        counted; a range without rows has no row."""
        if not ranges:
            raise ValueError("give at least one range")
        rows = self._read(spark, "sales_ids", SALES_IDS)
        wanted = _in_days(min(a for a, _ in ranges), max(b for _, b in ranges))
        own = F.array(*[F.when(_in_days(a, b), F.lit(i)) for i, (a, b) in enumerate(ranges)])
        hits = rows.where(wanted).withColumn("range", F.explode(F.array_compact(own)))
        keys = ["range", *(["salesman_id"] if by_salesman else [])]
        merged = hits.groupBy(*keys, "kind", "word").agg(F.bit_or("bits").alias("bits"))
        n = F.bit_count("bits")
        counted = merged.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"total_{k}s")
                                              for k in ("order", "customer")])
        dates = F.array(*[F.struct(F.lit(a).alias("date_from"), F.lit(b).alias("date_to")) for a, b in ranges])
        counted = counted.withColumn("range", F.get(dates, F.col("range")))
        return counted.select("range.*", *keys[1:], "total_orders", "total_customers")
