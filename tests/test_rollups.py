"""Stored daily partials give what the direct reports give, after refreshes with late rows, repeats and empty batches."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillage.operators.rollups import DailyRollups
from tillage.plans import admin, depot
from tillage.plans.sales import salesman_summary

ORDERS = "id long, customer_id long, final_amount decimal(12,2), payment_status string, order_status string, created_at timestamp_ntz, note string"
AS_OF = dt.datetime(2001, 8, 1, 6, 0, 0)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = random.Random(5)
    edges = [dt.datetime(2001, 2, 1, 5, 59, 59), dt.datetime(2001, 2, 1, 6), dt.datetime(2001, 7, 25, 6), dt.datetime(2001, 7, 25, 5),
             dt.datetime(2001, 7, 2), dt.datetime(2001, 8, 2), dt.datetime(2001, 8, 2, 0, 0, 1), dt.datetime(2001, 7, 1, 23, 59, 59), None]
    times = edges * 3 + [dt.datetime(2001, 1, 1) + dt.timedelta(minutes=rng.randrange(220 * 1440)) for _ in range(400)]
    # A third of the orders are one customer's; ids reach over several bitmap buckets and below zero.
    orders = [(i * 997 - 5000, rng.choice([7, rng.randrange(10 ** 6), None]), Decimal(rng.randrange(10 ** 5)) / 100, rng.choice(["paid", "paid", "pending", None]),
               "placed", t, "x") for i, t in enumerate(times)]
    items = [(o[0], rng.choice([1, rng.randrange(1, 6)]), rng.randrange(1, 9), rng.randrange(9999) / 100) for o in orders for _ in range(rng.randrange(4))]
    made = {
        "orders": spark.createDataFrame(orders, ORDERS),
        "items": spark.createDataFrame(items + [(10 ** 9, 1, 5, 1.0)], "order_id long, product_id long, quantity int, total double")
        .withColumn("total", F.col("total").cast("decimal(12,2)")),
        "products": spark.createDataFrame([(i, f"p{i}", 1 if i < 4 else None, 10) for i in range(1, 6)], "id long, name string, category_id int, stock_qty int"),
        "categories": spark.createDataFrame([(1, "c")], "id int, name string"),
        "salesmen": spark.createDataFrame([(i, f"s{i}", None) for i in range(3)], "id long, name string, distributor_id long"),
        "bridge": spark.createDataFrame([(o[0], s) for o in orders for s in rng.sample(range(3), rng.randrange(3))], "order_id long, salesman_id long"),
    }
    rollups = DailyRollups(str(tmp_path_factory.mktemp("rollups")))
    late = F.coalesce(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, F.lit(False)) | F.coalesce(F.col("created_at") >= F.lit(AS_OF), F.lit(True))
    for batch, df in (("a", made["orders"].where(~late)), ("none", made["orders"].limit(0)), ("b", made["orders"].where(late))):
        before = files(rollups.path)
        for _ in range(2 if batch == "b" else 1):  # a repeated refresh counts once
            rollups.refresh(batch, df, made["items"]).refresh_salesmen(batch, made["bridge"], df)
        assert all(files(rollups.path).get(f) == t for f, t in before.items())
    return {**made, "rollups": rollups}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("as_of", [AS_OF, dt.datetime(2001, 7, 31), dt.datetime(2001, 2, 28, 23, 59), dt.datetime(1999, 1, 1)])
def test_trailing_reports(shop, as_of):
    r, o = shop["rollups"], shop["orders"]
    assert rows(r.monthly_revenue(o, as_of)) == rows(admin.monthly_revenue(o, as_of))
    assert rows(r.monthly_sales(o, as_of)) == rows(admin.monthly_sales(o, as_of))
    assert rows(r.daily_sales(o, as_of)) == rows(admin.daily_sales(o, as_of))


def test_totals_and_fast_moving(shop):
    r, o = shop["rollups"], shop["orders"]
    assert rows(r.revenue_summary(o)) == rows(admin.revenue_summary(o))
    for a, b in [("2001-07-02", "2001-08-01"), ("2001-01-01", "2001-12-31"), ("1990-01-01", "1990-02-01")]:
        got = r.fast_moving(shop["products"], shop["categories"], dt.date.fromisoformat(a), dt.date.fromisoformat(b))
        assert rows(got) == rows(depot.fast_moving(shop["items"], shop["products"], shop["categories"], o, a, b))


def test_distinct_counts_for_any_range(spark, shop):
    ranges = [(dt.date(2001, 7, 2), dt.date(2001, 8, 1)), (dt.date(2001, 1, 1), dt.date(2001, 12, 31)), (dt.date(2001, 7, 25), dt.date(2001, 7, 25)),
              (dt.date(1990, 1, 1), dt.date(1990, 1, 2))]
    for by_salesman in (False, True):
        want = []
        for a, b in ranges:
            direct = salesman_summary(shop["bridge"], shop["salesmen"], shop["orders"], str(a), str(b), by_salesman=by_salesman).drop("total_amount")
            want += [(a, b, *x) for x in direct.collect() if x[-2]]
        assert rows(shop["rollups"].distinct_sales(spark, ranges, by_salesman)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        shop["rollups"].distinct_sales(spark, [])


def test_no_refresh_gives_empty_reports(spark, shop, tmp_path):
    none = DailyRollups(str(tmp_path)).refresh("a", shop["orders"].limit(0), shop["items"]).refresh_salesmen("a", shop["bridge"], shop["orders"].limit(0))
    assert none.monthly_sales(shop["orders"].limit(0), AS_OF).count() == 0
    assert none.revenue_summary(shop["orders"].limit(0)).first().asDict() == {"total_revenue": 0, "total_orders": 0}
    assert none.distinct_sales(spark, [(dt.date(2001, 1, 1), dt.date(2001, 2, 1))]).count() == 0


def test_reports_read_the_months_they_need(spark, shop):
    plan = shop["rollups"].fast_moving(shop["products"], shop["categories"], dt.date(2001, 7, 2), dt.date(2001, 7, 9))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "200107" in plan


def test_a_stored_bitmap_is_one_word(spark, shop):
    """A bitmap of 4 KB an id before, where a day's ids lie far apart."""
    stored = spark.read.parquet(f"{shop['rollups'].path}/sales_ids")
    assert dict(stored.dtypes)["bits"] == "bigint"
    ids = shop["bridge"].join(shop["orders"].where("created_at IS NOT NULL"), F.col("order_id") == F.col("id"))
    assert stored.where("kind = 'order'").agg(F.sum(F.bit_count("bits"))).first()[0] == ids.count()
