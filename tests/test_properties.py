"""Property tests for the driver-side helpers (parameters, clocks, query text)."""

import calendar
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from tillage.functions.text import ENGLISH_STOP_WORDS, query_lexemes
from tillage.operators.filters import months_before, php_truthy
from tillage.operators.paging import clamp_page


@given(st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2100, 12, 31)),
       st.integers(min_value=0, max_value=240))
def test_months_before_clamps_to_month_end(ts, n):
    got = months_before(ts, n)
    assert (ts.year * 12 + ts.month) - (got.year * 12 + got.month) == n
    last = calendar.monthrange(got.year, got.month)[1]
    assert got.day == min(ts.day, last)
    assert got.time() == ts.time()


@given(st.one_of(st.none(), st.text(max_size=6), st.integers(-5, 500)),
       st.one_of(st.none(), st.text(max_size=6), st.integers(-5, 500)),
       st.sampled_from([50, 100]))
def test_page_clamp_bounds(page, limit, cap):
    p, lim = clamp_page(page, limit, cap)
    assert p >= 1 and 1 <= lim <= cap


@given(st.text(max_size=40))
@settings(max_examples=200)
def test_query_lexemes_are_lowercase_distinct_and_not_stop_words(q):
    lx = query_lexemes(q)
    assert len(lx) == len(set(lx))
    assert all(w == w.lower() and w and w not in ENGLISH_STOP_WORDS for w in lx)


@given(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=3), st.lists(st.integers(), max_size=2)))
def test_php_truthiness(v):
    falsy = v in (None, False, 0, "", "0") or v == []
    assert php_truthy(v) is (not falsy)


events = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400), st.one_of(st.none(), st.integers(0, 9))),
                  min_size=1, max_size=60)


@given(events, st.sampled_from([3600, 86_400, 7 * 86_400]))
@settings(max_examples=8, deadline=None)
def test_segmented_prior_values_equal_a_plain_window(spark, rows, bucket):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tillage.operators.sequences import prior_values
    base = dt.datetime(2024, 1, 1)
    data = [(k, i, base + dt.timedelta(hours=h), v) for i, (k, h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, id int, ts timestamp_ntz, v int")
    got = prior_values(df, ["k"], ["ts", "id"], {"pv": F.col("v")}, bucket_seconds=bucket)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.last("v", True).over(w).alias("pv"))
    assert sorted((r.id, r.pv) for r in got.collect()) == sorted((r.id, r.pv) for r in want.collect())


@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.booleans())), min_size=1, max_size=80),
       st.sampled_from([1, 4, 64]))
@settings(max_examples=6, deadline=None)
def test_running_position_equals_row_number(spark, rows, seg_rows):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tillage.plans.customer import address_book
    df = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(rows)], "id long, customer_id long, is_default boolean")
    got = address_book(df, segment_rows=seg_rows)
    w = Window.partitionBy("customer_id").orderBy(F.col("is_default").desc(), F.col("id").desc())
    want = df.withColumn("position", F.row_number().over(w))
    assert sorted((r.id, r.position) for r in got.collect()) == sorted((r.id, r.position) for r in want.collect())
