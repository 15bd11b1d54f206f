"""R29 joins lines to orders in tasks of bounded size, whatever the session's number of shuffle partitions."""

from decimal import Decimal

import pytest

from tillage.plans import vendor


@pytest.mark.parametrize("variant", vendor.VARIANTS)
def test_tasks_of_the_order_join_grow_with_the_lines(spark, monkeypatch, variant):
    money = "decimal(12,2)"
    lines = spark.createDataFrame([(i % 30 if i % 30 else None, i % 7, Decimal(i)) for i in range(101)], f"order_id long, product_id long, total {money}")
    orders = spark.createDataFrame([(i, "paid" if i != 6 else "failed") for i in [*range(1, 28), 5, None]], "id long, payment_status string")
    products = spark.createDataFrame([(i, i % 2 if i else None, True) for i in range(6)], "id long, vendor_id long, is_active boolean")
    reviews = spark.createDataFrame([(1, 4), (1, 5), (2, 1), (6, 3), (None, 2)], "product_id long, rating int")
    vendors = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    args = (vendors, lines, orders, products, reviews, variant)
    want = sorted(map(tuple, vendor.vendor_kpis(*args).collect()))
    monkeypatch.setattr(vendor, "LINES_A_TASK", 5)
    df = vendor.vendor_kpis(*args)
    plan = df._jdf.queryExecution().toString()
    assert plan.count(", 21), REPARTITION_BY_NUM") >= 2  # lines and orders
    assert sorted(map(tuple, df.collect())) == want and want[0][2] > 0 and want[2] == (2, 0, 0, 0, 0)
