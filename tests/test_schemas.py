"""Files of several versions under one schema."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tillage.sources.schemas import DDL, DEFAULTS, WITHHELD, common_schema, conform, misfit_report, read_versions, reconciled, schema, widened


def test_every_default_fits_its_column(spark):
    assert len(DDL) == 38  # 37 tables and the shared shape of invoice lines
    for table, values in DEFAULTS.items():
        assert set(values) <= set(schema(table).names)
        row = conform(spark.createDataFrame([(None,)], "nothing string"), table).first()
        assert all(row[c] == v for c, v in values.items())
    assert not WITHHELD & {c for t in DDL for c in schema(t).names}


@pytest.mark.parametrize("a, b, want", [
    ("int", "bigint", "bigint"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("int", "decimal(4,2)", "decimal(12,2)"),
    ("int", "double", "double"), ("date", "timestamp_ntz", "timestamp_ntz"), ("decimal(38,0)", "decimal(38,10)", None),
    ("int", "string", None), ("boolean", "int", None), ("string", "string", "string")])
def test_widened(a, b, want):
    one, two = (T.StructType.fromDDL(f"x {t}")[0].dataType for t in (a, b))
    both = want and T.StructType.fromDDL(f"x {want}")[0].dataType
    assert widened(one, two) == widened(two, one) == both


def test_mixed_files(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "9.5", "h"), (2, None, "dear", None), (2, None, "dear", None)],
                                "ID int, `Stock_Qty` smallint, selling_price string, password_hash string")
    new = spark.createDataFrame([("9f-uuid", 2 ** 40, Decimal("12345678901.125"), dt.datetime(2001, 1, 1), 7)],
                                "id string, stock_qty bigint, selling_price decimal(14,3), created_at timestamp_ntz, `odd.name` int")
    newer = spark.createDataFrame([("a", "x"), (None, None)], "id string, `odd.name` string")
    none = newer.limit(0)
    paths = []
    for i, df in enumerate((old, new, newer, none)):
        paths.append(f"{tmp_path}/v{i}")
        df.write.parquet(paths[-1])
    df = read_versions(spark, paths, "products", "misfits")
    assert df.columns == [*schema("products").names, "odd.name", "misfits"]
    types = dict(df.dtypes)
    assert (types["id"], types["stock_qty"], types["selling_price"], types["odd.name"]) == ("string", "bigint", "decimal(14,3)", "string")
    got = sorted(((r.id, r.stock_qty, r.selling_price, r["odd.name"], r.unit, r.created_at, r.misfits) for r in df.collect()), key=repr)
    assert got == sorted([
        ("1", 5, Decimal("9.500"), None, "Piece", None, []), ("2", None, None, None, "Piece", None, ["selling_price"]),
        ("2", None, None, None, "Piece", None, ["selling_price"]),
        ("9f-uuid", 2 ** 40, Decimal("12345678901.125"), "7", "Piece", dt.datetime(2001, 1, 1), []),
        ("a", 0, None, "x", "Piece", None, []), (None, 0, None, None, "Piece", None, [])], key=repr)
    assert [tuple(r) for r in misfit_report(df, "misfits").collect()] == [("selling_price", 2)]
    plan = df.where("created_at >= timestamp_ntz'2001-01-01 00:00:00'").select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "ReadSchema: struct<id:string,created_at:timestamp_ntz>" in plan


def test_tables_without_rows_or_extras(spark):
    df = spark.createDataFrame([], "id bigint")
    assert conform(df, "orders").columns == schema("orders").names and conform(df, "orders").count() == 0
    assert reconciled([df], "orders", "m").schema["m"].dataType == T.ArrayType(T.StringType())
    assert common_schema([df, df], "orders") == schema("orders")
