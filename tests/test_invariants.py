
import pytest
from pyspark.sql import functions as F

from tillage.operators import changes as ch
from tillage.plans import customer, depot, sales, vendor
from tillage.sources.fixtures import Catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog(spark, SF)


def test_corrected_never_exceeds_as_written(cat):
    for fn, key, col in [
        (lambda v: vendor.vendor_kpis(cat.vendors, cat.order_items, cat.orders, cat.products, cat.reviews, v),
         "vendor_id", "total_revenue"),
        (lambda v: customer.customer_360(cat.customers, cat.users, cat.orders, cat.wishlist, cat.reviews, v,
                                         wishlist_key="product_id").select("id", "stats.total_spent"),
         "id", "total_spent"),
    ]:
        aw = {r[key]: r[col] for r in fn("as_written").collect()}
        co = {r[key]: r[col] for r in fn("corrected").collect()}
        assert aw.keys() == co.keys()
        assert all(co[k] <= aw[k] for k in aw)
        assert any(co[k] < aw[k] for k in aw)
    args = (cat.salesman_orders, cat.salesmen, cat.orders, "1995-01-01", "2001-12-31")
    aw = sales.salesman_summary(*args, variant="as_written").collect()[0]
    co = sales.salesman_summary(*args, variant="corrected").collect()[0]
    assert co.total_amount <= aw.total_amount and co.total_orders == aw.total_orders


def test_pages_add_up_to_total(cat):
    def pg(n):
        return depot.warehouse_stock(cat.warehouse_inventory, cat.warehouses, cat.cnf_companies, cat.products,
                                     cat.categories, expiry_status="good", sort="expiry", page_no=n, limit=100)
    first = pg(1).collect()
    total = first[0].total
    seen = len(first)
    n = 2
    while seen < total:
        got = pg(n).collect()
        assert got, "a page ended early"
        seen += len(got)
        n += 1
    assert seen == total


def test_ledger_net_equals_stock_delta(cat):
    led = ch.stock_ledger(cat.products, cat.stock_movements)
    before = cat.products.agg(F.sum("stock_qty")).collect()[0][0]
    after = led.agg(F.sum("stock_qty")).collect()[0][0]
    known = cat.stock_movements.join(cat.products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    assert after - before == known.agg(F.sum("delta")).collect()[0][0]


def test_accepted_plus_rejected_is_input(cat):
    out = ch.apply_status_events(cat.orders, cat.status_events)
    n = out.agg(F.sum(F.col("accepted_events") + F.col("rejected_events"))).collect()[0][0]
    known = cat.status_events.join(cat.orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    assert n == known.count()
    reg = cat.base("events").where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    split = ch.split_duplicates(reg, cat.users.where(F.col("role") != "customer").select("id"), ["id"],
                                ["created_at", "seq"])
    counts = {r.decision: r["count"] for r in split.groupBy("decision").count().collect()}
    assert sum(counts.values()) == reg.count()
    assert counts["accepted"] == reg.join(cat.users.where(F.col("role") != "customer").select("id"), "id",
                                          "left_anti").select("id").distinct().count()
