
import contextlib
import datetime as dt
import io
from decimal import Decimal

from pyspark.sql import functions as F

from tillage.functions import exprs as E
from tillage.functions.text import lexemes, matches, query_lexemes
from tillage.operators import changes as ch
from tillage.operators import filters as flt
from tillage.operators import quality as q
from tillage.operators.paging import clamp_page, page_meta, pg_desc
from tillage.operators.pricing import price_orders
from tillage.plans import access, admin, customer, depot
from tillage.sources.json_io import page_envelope
from tillage.sources.literals import seed_settings

AS_OF = dt.datetime(2024, 3, 7, 6, 0, 0)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_day_boundary_includes_next_midnight(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 31, 0, 0, 0)), (2, dt.datetime(2024, 1, 31, 0, 0, 1)),
                                (3, dt.datetime(2024, 1, 1, 0, 0, 0))], "id int, ts timestamp_ntz")
    kept = df.where(flt.between_to_next_midnight("ts", "2024-01-01", "2024-01-30"))
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    day = df.where(flt.on_day("ts", "2024-01-31"))
    assert sorted(r.id for r in day.collect()) == [1, 2]


def test_expiry_bands_today_is_expired_and_null_is_no_expiry(spark):
    d = AS_OF.date()
    cases = [d - dt.timedelta(days=1), d, d + dt.timedelta(days=7), d + dt.timedelta(days=8),
             d + dt.timedelta(days=30), d + dt.timedelta(days=31), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, e date")
    out = df.select("i", depot.stock_status(F.col("e"), AS_OF).alias("s"),
                    depot.expiry_status_report(F.col("e"), AS_OF).alias("r"),
                    E.whole_days_until("e", AS_OF).alias("days")).orderBy("i")
    got = rows(out, "s", "r", "days")
    assert got == [("expired", "expired", -1), ("expired", "expired", 0), ("expiring_soon", "expiring_7", 6),
                   ("expiring_soon", "expiring_30", 7), ("expiring_soon", "expiring_30", 29),
                   ("good", "good", 30), ("no_expiry", "good", None)]
    good = df.where(flt.expiry_band_stock("e", "good", AS_OF))
    assert sorted(r.i for r in good.collect()) == [5, 6]


def test_whole_days_truncate_toward_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 5),), (dt.date(2024, 3, 10),)], "e date")
    got = [r[0] for r in df.select(E.whole_days_until("e", dt.datetime(2024, 3, 7, 6))).collect()]
    assert got == [-2, 2]


def test_desc_puts_nulls_first_like_postgres(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 5.0)], "id int, avg_rating double")
    assert [r.id for r in df.orderBy(pg_desc("avg_rating")).collect()] == [2, 3, 1]


def test_two_default_addresses_show_twice_but_count_once(spark):
    customers = spark.createDataFrame([(1, 1, "C1", dt.date(2024, 1, 1)), (2, 2, "C2", dt.date(2024, 1, 2))],
                                      "id long, user_id long, customer_code string, created_at date")
    users = spark.createDataFrame([(1, "Ann", "Lee", True), (2, "Bob", "Ray", True)],
                                  "id long, first_name string, last_name string, is_active boolean")
    addresses = spark.createDataFrame([(10, 1, "Pune", "MH", True), (11, 1, "Nashik", "MH", True),
                                       (12, 2, "Goa", "GA", False)],
                                      "id long, customer_id long, city string, state string, is_default boolean")
    out = admin.customer_search(customers, users, addresses).collect()
    assert len(out) == 3
    assert {r.total for r in out} == {2}
    assert sorted(r.city or "" for r in out if r.id == 1) == ["Nashik", "Pune"]


def test_search_keeps_wildcards(spark):
    df = spark.createDataFrame([("50% off",), ("5 off",), ("a_b",), ("ab",)], "name string")
    assert [r.name for r in df.where(flt.contains_ci(["name"], "50%")).collect()] == ["50% off"]
    assert sorted(r.name for r in df.where(flt.contains_ci(["name"], "a_b")).collect()) == ["a_b"]
    assert sorted(r.name for r in df.where(flt.contains_ci(["name"], "%")).collect()) == ["5 off", "50% off", "a_b", "ab"]


COUPON_SCHEMA = ("code string, discount_type string, discount_value decimal(10,2), minimum_order_amount decimal(10,2), "
                 "max_discount decimal(10,2), is_active boolean, valid_from timestamp_ntz, valid_to timestamp_ntz")


def _pricing(spark, cart_rows, coupons, code):
    products = spark.createDataFrame([(1, Decimal("100.00"), 10, True), (2, Decimal("498.99"), 10, True),
                                      (3, Decimal("499.00"), 10, True), (4, Decimal("50.00"), 1, True)],
                                     "id long, selling_price decimal(10,2), stock_qty int, is_active boolean")
    cart = spark.createDataFrame(cart_rows, "customer_id long, product_id long, quantity int")
    req = spark.createDataFrame([(7, code)], "customer_id long, coupon_code string")
    cp = spark.createDataFrame(coupons, COUPON_SCHEMA)
    return price_orders(req, cart, products, cp, seed_settings(spark), AS_OF).collect()[0]


def test_coupon_cap_minimum_and_flat(spark):
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)
    coupons = [("PCT", "percentage", Decimal("10.00"), Decimal("299.00"), Decimal("20.00"), True, start, end),
               ("PCTNOCAP", "percentage", Decimal("10.00"), Decimal("299.00"), None, True, start, end),
               ("FLAT", "flat", Decimal("500.00"), Decimal("100.00"), None, True, start, end),
               ("OLD", "flat", Decimal("50.00"), Decimal("0.00"), None, True, start, dt.datetime(2024, 2, 1))]
    r = _pricing(spark, [(7, 3, 1)], coupons, " pct ")
    assert (r.subtotal, r.discount, r.delivery, r.total) == (Decimal("499.00"), Decimal("20.00"), Decimal("0.00"),
                                                             Decimal("479.00"))
    r = _pricing(spark, [(7, 3, 1)], coupons, "PCTNOCAP")
    assert r.discount == Decimal("49.90")
    r = _pricing(spark, [(7, 1, 2)], coupons, "FLAT")  # flat above subtotal is not capped
    assert (r.subtotal, r.discount, r.total) == (Decimal("200.00"), Decimal("500.00"), Decimal("-251.00"))
    r = _pricing(spark, [(7, 1, 1)], coupons, "PCT")  # below minimum: no discount, still counted as used
    assert (r.discount, r.coupon_used) == (Decimal("0.00"), True)
    r = _pricing(spark, [(7, 1, 1)], coupons, "OLD")  # expired coupon
    assert (r.discount, r.coupon_used) == (Decimal("0.00"), False)
    r = _pricing(spark, [(7, 4, 2)], coupons, None)  # quantity over stock
    assert r.status == "rejected_stock" and r.total is None


def test_delivery_threshold(spark):
    assert _pricing(spark, [(7, 2, 1)], [], None).delivery == Decimal("49.00")
    assert _pricing(spark, [(7, 3, 1)], [], None).delivery == Decimal("0.00")


def test_fan_out_variants(spark):
    customers = spark.createDataFrame([(1, 1, "C1", "x")], "id long, user_id long, customer_code string, occupation string")
    users = spark.createDataFrame([(1, "Ann", "Lee")], "id long, first_name string, last_name string")
    orders = spark.createDataFrame([(1, 1, Decimal("100.00"), "paid")],
                                   "id long, customer_id long, final_amount decimal(12,2), payment_status string")
    wishlist = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, customer_id long, product_id long")
    reviews = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, customer_id long")
    aw = customer.customer_360(customers, users, orders, wishlist, reviews, "as_written").collect()[0]
    co = customer.customer_360(customers, users, orders, wishlist, reviews, "corrected").collect()[0]
    assert co.stats.total_spent == Decimal("100.00")
    assert aw.stats.total_spent == Decimal("600.00")
    assert (aw.stats.wishlist_count, aw.stats.review_count, aw.full_name) == (2, 3, "Ann Lee")


def test_patch_null_modes(spark):
    cur = spark.createDataFrame([(1, 5, "kg"), (2, 7, "box")], "id long, stock_qty int, unit string")
    patches = spark.createDataFrame([(1, None, "bag", ["stock_qty", "unit"], 1), (2, 9, None, ["stock_qty"], 1),
                                     (2, 11, None, ["unit"], 2)],
                                    "id long, stock_qty int, unit string, present array<string>, seq int")
    ex = {r.id: (r.stock_qty, r.unit) for r in ch.sparse_patch(cur, patches, "id", ["stock_qty", "unit"],
                                                                  ["seq"], "exists").collect()}
    iss = {r.id: (r.stock_qty, r.unit) for r in ch.sparse_patch(cur, patches, "id", ["stock_qty", "unit"],
                                                                   ["seq"], "isset").collect()}
    assert ex == {1: (None, "bag"), 2: (9, None)}
    assert iss == {1: (5, "bag"), 2: (9, "box")}


def test_upsert_last_wins_and_keeps_unlisted_columns(spark):
    cur = spark.createDataFrame([(1, 1, "B1", dt.date(2025, 1, 1), 10)],
                                "warehouse_id int, product_id int, batch string, expiry_date date, current_stock int")
    chg = spark.createDataFrame([(1, 1, "B1", dt.date(2030, 1, 1), 20, 1), (1, 1, "B1", dt.date(2031, 1, 1), 30, 2),
                                 (2, 1, "B1", dt.date(2026, 1, 1), 5, 1)],
                                "warehouse_id int, product_id int, batch string, expiry_date date, current_stock int, seq int")
    out = ch.upsert(cur, chg, ["warehouse_id", "product_id", "batch"], ["current_stock"], ["seq"])
    got = {r.warehouse_id: (r.expiry_date, r.current_stock) for r in out.collect()}
    assert got == {1: (dt.date(2025, 1, 1), 30), 2: (dt.date(2026, 1, 1), 5)}


def test_status_rules(spark):
    orders = spark.createDataFrame([(1, "placed", "pending"), (2, "placed", "pending"), (3, "confirmed", "pending")],
                                   "id long, order_status string, payment_status string")
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, 1, "shipped", t), (2, 1, "cancelled", t + dt.timedelta(hours=1)),        # cancel after shipped: rejected
        (3, 2, "delivered", t),                                                      # delivered -> paid
        (4, 3, "cancelled", t), (5, 3, "cancelled", t + dt.timedelta(hours=1)),      # second cancel rejected
        (6, 3, "bogus", t + dt.timedelta(hours=2))],
        "id long, order_id long, status string, created_at timestamp_ntz")
    got = {r.id: (r.order_status, r.payment_status, r.accepted_events, r.rejected_events)
           for r in ch.apply_status_events(orders, ev).collect()}
    assert got == {1: ("shipped", "pending", 1, 1), 2: ("delivered", "paid", 1, 0), 3: ("cancelled", "pending", 1, 2)}


def test_validators(spark):
    df = spark.createDataFrame([("9876543210", "a@b.co", "123e4567-e89b-12d3-a456-426614174000"),
                                ("5876543210", "a@b", "123E4567-E89B-12D3-A456-426614174000"),
                                ("98765", "", "xyz"), (None, None, None)], "mobile string, email string, id string")
    rep = q.quality_report({"t": (df, [q.mobile("mobile"), q.email("email"), q.uuid("id"), q.required("email")])})
    got = {r.rule: r.violations for r in rep.collect()}
    assert got == {"mobile_mobile": 3, "email_email": 3, "id_uuid": 2, "email_required": 2}
    qd = q.quarantine(df, [q.mobile("mobile")]).where(F.size("failed_rules") == 0).count()
    assert qd == 1


def test_ledger_cancel_restores_stock_not_sold(spark):
    products = spark.createDataFrame([(1, 10)], "id long, stock_qty int")
    mv = spark.createDataFrame([(1, "order", -3), (1, "cancel", 3), (1, "restock", 10), (1, "order", -2)],
                               "product_id long, kind string, delta int")
    r = ch.stock_ledger(products, mv).collect()[0]
    assert (r.stock_qty, r.sold_count) == (18, 5)


def test_insert_ignore_and_duplicate_split(spark):
    cur = spark.createDataFrame([(1, 1, 0)], "customer_id long, product_id long, seq int")
    new = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 2, 6)], "customer_id long, product_id long, seq int")
    out = sorted(rows(ch.insert_ignore(cur, new, ["customer_id", "product_id"], ["seq"]), "product_id", "seq"))
    assert out == [(1, 0), (2, 6)]
    dec = sorted(rows(ch.split_duplicates(new, cur, ["customer_id", "product_id"], ["seq"]), "product_id", "seq",
                      "decision"))
    assert dec == [(1, 5, "exists"), (2, 6, "accepted"), (2, 7, "duplicate_in_batch")]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("Drip Pipe 16MM", " Ann  Marie Lee ", "12abc", "Office")],
                               "name string, full string, n string, t string")
    first, last = E.split_name("full")
    r = df.select(E.slug("name").alias("slug"), first.alias("f"), last.alias("l"), E.php_int("n").alias("i"),
                  E.address_type("t").alias("t"), E.code_from_id("PRD-", F.lit("abcdef12-3456")).alias("c"),
                  E.money_round(F.lit(Decimal("2.345"))).alias("m"), E.zero_pad(F.lit(42), 5).alias("p"),
                  E.module_key(F.lit("Cnf-Stock!")).alias("k")).collect()[0]
    assert (r.slug, r.f, r.l, r.i, r.t, r.c, r.m, r.p, r.k) == (
        "-rip-ipe-16-", "Ann", " Marie Lee", 12, "work", "PRD-ABCDEF12", Decimal("2.35"), "00042", "cnfstock")


def test_first_n_positions(spark):
    df = spark.createDataFrame([(["u1", "u2", "u3"],)], "imgs array<string>")
    r = df.select(F.inline(E.first_n_positions("imgs", 2))).collect()
    assert [(x.pos, x.value, x.is_first) for x in r] == [(0, "u1", True), (1, "u2", False)]


def test_month_clamp_and_page_clamp():
    assert flt.months_before(dt.datetime(2024, 8, 31, 6), 6) == dt.datetime(2024, 2, 29, 6)
    assert clamp_page("0", "500", 100) == (1, 100)
    assert clamp_page("3", "abc", 50) == (3, 1)


def test_text_match(spark):
    df = spark.createDataFrame([(1, "The Red Drip-Pipe"), (2, "red apples and the pipes"), (3, None)],
                               "id int, t string")
    lx = df.select("id", lexemes("t").alias("lx"))
    assert sorted(r.id for r in lx.where(matches("lx", "red pipe")).collect()) == [1]
    assert lx.where(matches("lx", "the and")).count() == 0
    assert query_lexemes("The RED pipe") == ["red", "pipe"]
    assert [sorted(r.lx) for r in lx.orderBy("id").collect()][0] == ["drip", "pipe", "red"]


def test_settings_map_and_envelope(spark):
    m = access.settings_map(seed_settings(spark)).collect()[0].settings
    assert m["delivery_charge"] == "49" and len(m) == 3
    page_rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    meta = page_meta(spark.range(1).select(F.lit(41).alias("total")), 1, 20)
    js = page_envelope(page_rows, meta, [F.col("id").desc()]).collect()[0].json
    assert '"data":[{"id":2,"name":"b"},{"id":1,"name":"a"}]' in js
    from tillage.sources.json_io import explode_json_array
    slides = explode_json_array(seed_settings(spark), "opening_days", "struct<day:string,hours:int>").collect()
    assert [(r.pos, r.item.day, r.item.hours) for r in slides] == [(0, "Monday", 8), (1, "Tuesday", 6)]
    assert js.startswith('{"success":true,"data":[') and '"pages":3' in js


def test_apply_batches_checkpoints(spark):
    cur = spark.createDataFrame([(1, 0)], "id long, v int")
    batches = [spark.createDataFrame([(1, i, i)], "id long, v int, seq int") for i in range(1, 6)]
    out = ch.apply_batches(cur, batches, lambda c, b: ch.upsert(c, b, ["id"], ["v"], ["seq"]), checkpoint_every=2)
    assert out.collect()[0].v == 5


def test_prior_values_spans_segments_of_a_hot_key(spark):
    from pyspark.sql import Window

    from tillage.operators.sequences import prior_values
    base = dt.datetime(2024, 1, 1)
    rows_ = [(1 if i % 10 else 2, i, base + dt.timedelta(hours=7 * i), None if i % 4 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows_, "k int, id int, ts timestamp_ntz, v int")
    got = prior_values(df, ["k"], ["ts", "id"], {"pv": F.col("v"), "prev_row": F.struct("id")}, bucket_seconds=86_400)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "id", F.last("v", True).over(w).alias("pv"),
                     F.lag("id").over(Window.partitionBy("k").orderBy("ts", "id")).alias("prev"))
    a = sorted(rows(got.select("id", "pv", F.col("prev_row.id").alias("prev")), "id", "pv", "prev"))
    b = sorted(rows(want, "id", "pv", "prev"))
    assert a == b


def test_conform_to_declared_schema(spark):
    from tillage.sources.schemas import DDL, conform
    df = spark.createDataFrame([(1, "9.5", "x")], "id int, selling_price string, junk string")
    out = conform(df, "products")
    assert out.columns == [f.split()[0] for f in DDL["products"].split(", ")] + ["junk"]
    r = out.collect()[0]
    assert (r.id, str(r.selling_price), r.name, r.junk) == (1, "9.50", None, "x")


def test_index_search_matches_scan_search(spark):
    from tillage.functions.text import inverted_index, search_index
    df = spark.createDataFrame([(1, "The Red Drip-Pipe"), (2, "red apples and the pipes"), (3, None)],
                               "id int, t string")
    lx = df.select("id", lexemes("t").alias("lx"))
    idx = inverted_index(lx, "id", "lx")
    assert [r.id for r in search_index(idx, "id", "red pipe").collect()] == [1]
    assert search_index(idx, "id", "the and").count() == 0
    assert sorted(r.id for r in search_index(idx, "id", "RED").collect()) == [1, 2]


def test_vendor_decisions(spark):
    vendors = spark.createDataFrame([("abcdef12-aa", "pending"), ("bbbbbbbb-cc", "pending"), ("cccccccc-dd", "approved"),
                                     ("dddddddd-ee", "pending")], "id string, status string")
    t = dt.datetime(2024, 1, 1)
    dec = spark.createDataFrame([
        ("abcdef12-aa", "approve", t, 1), ("abcdef12-aa", "approve", t + dt.timedelta(hours=1), 2),
        ("bbbbbbbb-cc", "reject", t, 3), ("bbbbbbbb-cc", "approve", t + dt.timedelta(hours=1), 4),
        ("cccccccc-dd", "approve", t, 5),
        ("dddddddd-ee", "approve", t, 6), ("dddddddd-ee", "reject", t + dt.timedelta(hours=1), 7)],
        "vendor_id string, action string, created_at timestamp_ntz, id int")
    got = {r.id: (r.status, r.vendor_code, r.applied_decisions, r.refused_decisions)
           for r in ch.apply_vendor_decisions(vendors, dec).collect()}
    assert got == {"abcdef12-aa": ("approved", "VND-ABCDEF12", 1, 1), "bbbbbbbb-cc": ("rejected", None, 1, 1),
                   "cccccccc-dd": ("approved", None, 0, 1), "dddddddd-ee": ("rejected", "VND-DDDDDDDD", 2, 0)}


def test_supply_status_latest_allowed(spark):
    orders = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    t = dt.datetime(2024, 1, 1)
    up = spark.createDataFrame([(1, "dispatched", t, 1), (1, "bogus", t + dt.timedelta(hours=1), 2),
                                (2, "cancelled", t, 3)], "order_id long, status string, created_at timestamp_ntz, id int")
    assert {r.id: r.status for r in ch.apply_supply_status(orders, up).collect()} == {1: "dispatched", 2: "cancelled"}


def test_partitioned_write_prunes_by_month(spark, tmp_path):
    from tillage.sources.tables import write_table
    df = spark.createDataFrame([(1, dt.datetime(2001, 1, 5)), (2, dt.datetime(2001, 2, 5))],
                               "id long, created_at timestamp_ntz").withColumn(
        "order_month", F.date_format("created_at", "yyyy-MM"))
    path = str(tmp_path / "orders")
    write_table(df, path, partition_by=["order_month"], sort_within=["id"])
    back = spark.read.parquet(path).where(F.col("order_month") == "2001-02")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        back.explain()
    assert "PartitionFilters: [isnotnull(order_month" in buf.getvalue()
    assert [r.id for r in back.collect()] == [2]


def test_address_positions_match_a_plain_window_for_a_hot_customer(spark):
    from pyspark.sql import Window
    rows_ = [(i, 1 if i % 5 else 2, [True, False, None][i % 3]) for i in range(5000)]
    df = spark.createDataFrame(rows_, "id long, customer_id long, is_default boolean")
    got = customer.address_book(df, segment_rows=64)
    w = Window.partitionBy("customer_id").orderBy(F.col("is_default").desc(), F.col("id").desc())
    want = df.withColumn("position", F.row_number().over(w).cast("bigint"))
    assert sorted(rows(got, "id", "position")) == sorted(rows(want, "id", "position"))


def test_keyset_pages_cover_offset_pages(spark):
    from tillage.operators.paging import keyset_page, page
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, grp long")
    keys = [("grp", "desc"), ("id", "asc")]
    order = [F.col("grp").desc(), F.col("id").asc()]
    after, seen = None, []
    for n in range(1, 5):
        got = keyset_page(df, keys, after, 30).collect()
        want = page(df, order, n, 30).collect()
        assert [(r.grp, r.id) for r in got] == [(r.grp, r.id) for r in want]
        seen += got
        if got:
            after = (got[-1].grp, got[-1].id)
    assert len(seen) == 100


def test_json_sink_keeps_unicode(spark, tmp_path):
    from tillage.sources.json_io import write_json
    df = spark.createDataFrame([(1, "Crème brûlée", None)], "id int, name string, note string")
    meta = page_meta(spark.range(1).select(F.lit(1).alias("total")), 1, 20)
    js = page_envelope(df, meta, [F.col("id")]).collect()[0].json
    assert "Crème brûlée" in js and '"note":null' in js
    path = str(tmp_path / "out")
    write_json(df, path)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "Crème brûlée" in text


def test_child_array_with_one_hot_parent(spark):
    from tillage.operators.joins import child_array
    parents = spark.createDataFrame([(i,) for i in range(50)], "id long")
    kids = spark.range(30000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("pid"),
                                     F.col("id").alias("seq"))
    out = child_array(parents, kids, "id", "pid", ["seq"], "kids")
    sizes = {r.id: r.n for r in out.select("id", F.size("kids").alias("n")).collect()}
    want = {r.pid: r["count"] for r in kids.groupBy("pid").count().collect()}
    assert sizes == {i: want.get(i, 0) for i in range(50)}
    first = out.where(F.col("id") == 7).select(F.col("kids")[0]["seq"].alias("s")).collect()[0].s
    assert first == 0 and sizes[7] > 10000


def test_erasure_blocked_by_non_cascading_references(spark):
    req = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    orders = spark.createDataFrame([(10, 1)], "id long, customer_id long")
    reviews = spark.createDataFrame([(20, 2)], "id long, customer_id long")
    cart = spark.createDataFrame([(1, 5), (3, 5), (3, 6)], "customer_id long, product_id long")
    rep = ch.erase_customers(req, {"orders": orders, "reviews": reviews}, {"cart": cart})
    got = {r.customer_id: (r.blocked, r.cart_rows, r.rows_removed) for r in rep.collect()}
    assert got == {1: (True, 1, 0), 2: (True, 0, 0), 3: (False, 2, 2)}
    assert sorted(rows(ch.erase_apply(cart, rep), "customer_id", "product_id")) == [(1, 5)]


def test_soft_delete_only_by_owner(spark):
    cur = spark.createDataFrame([(1, 10, True), (2, 20, True)], "id long, vendor_id long, is_active boolean")
    req = spark.createDataFrame([(1, 10), (2, 99)], "id long, vendor_id long")
    out = {r.id: r.is_active for r in ch.soft_delete(cur, req, "id", owner="vendor_id").collect()}
    assert out == {1: False, 2: True}
    assert {r.id: r.is_active for r in ch.soft_delete(cur, req, "id").collect()} == {1: False, 2: False}


def test_optional_reference_columns_flow_through(spark):
    customers = spark.createDataFrame([(1, 1, "C1")], "id long, user_id long, customer_code string")
    users = spark.createDataFrame([(1, "Ann", "Lee", "ann@x.in", "9876543210")],
                                  "id long, first_name string, last_name string, email string, mobile string")
    empty_orders = spark.createDataFrame([], "id long, customer_id long, final_amount decimal(12,2), payment_status string")
    empty = spark.createDataFrame([], "id long, customer_id long, product_id long")
    r = customer.customer_360(customers, users, empty_orders, empty, empty.select("id", "customer_id")).collect()[0]
    assert (r.email, r.mobile, r.stats.total_spent) == ("ann@x.in", "9876543210", Decimal("0.00"))
    orders = spark.createDataFrame([(5, 1, "DA-1", Decimal("9.99"), "paid", "placed", dt.datetime(2024, 1, 1))],
                                   "id long, customer_id long, order_number string, final_amount decimal(12,2), "
                                   "payment_status string, order_status string, created_at timestamp_ntz")
    top = admin.recent_orders(orders, customers, users).collect()[0]
    assert (top.order_number, top.customer_name) == ("DA-1", "Ann Lee")


def test_stock_reports_carry_the_whole_row(spark):
    import datetime as dt
    from tillage.plans.depot import expiry_report, warehouse_stock
    wi = spark.createDataFrame([(7, 1, 2, "b", dt.date(2001, 9, 1), 5, "rack 3", "own")],
                               "id int, warehouse_id int, product_id int, batch_number string, expiry_date date, current_stock int, rack string, sku string")
    names = [spark.createDataFrame(r, d) for r, d in (
        ([(1, 4, "W")], "id int, cnf_company_id int, name string"), ([(4, "C")], "id int, name string"),
        ([(2, "P", "S", 3)], "id int, name string, sku string, category_id int"), ([(3, "K", None)], "id int, name string, parent_id int"))]
    for report in (warehouse_stock, expiry_report):
        r = report(wi, *names).collect()[0]
        assert (r.id, r.rack, r.current_stock, r.product_name) == (7, "rack 3", 5, "P")


def test_lists_carry_all_columns_and_break_ties_by_id(spark):
    from tillage.plans import catalog
    from tillage.sources.schemas import conform
    cats = conform(spark.createDataFrame([(2, "b", "s2", "i", None), (1, "a", "s1", "j", None), (3, "c", "s3", "k", 1)],
                                         "id int, name string, slug string, icon string, parent_id int"), "categories")
    flat = catalog.category_list(cats).collect()
    assert [(r.id, r.slug, r.icon, r.is_featured, r.parent_name) for r in flat] == [
        (1, "s1", "j", False, None), (2, "s2", "i", False, None), (3, "s3", "k", False, "a")]
    assert [(r.id, r.image_url) for r in catalog.category_list(cats, parent_only=True).collect()] == [(1, None), (2, None)]
    brands = conform(spark.createDataFrame([(2, "x", "d2"), (1, "x", "d1")], "id int, name string, description string"), "brands")
    assert [(r.id, r.description, r.logo_url) for r in catalog.active_brands(brands).collect()] == [(1, "d1", None), (2, "d2", None)]
    wish = spark.createDataFrame([(9, 7, 2, AS_OF), (8, 7, 1, AS_OF)], "id int, customer_id int, product_id int, created_at timestamp_ntz")
    products = conform(spark.createDataFrame([(1, 5, 2), (2, 5, None)], "id int, vendor_id int, brand_id int"), "products")
    vendors = conform(spark.createDataFrame([(5, "v")], "id int, business_name string"), "vendors")
    got = catalog.wishlist_view(wish, products, vendors, brands, conform(spark.createDataFrame([], "id int"), "product_images")).collect()
    assert [(r.id, r.product_id, r.brand_name, r.vendor_name) for r in got] == [(8, 1, "x", "v"), (9, 2, None, "v")]
