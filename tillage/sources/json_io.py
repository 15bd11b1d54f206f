"""S4 JSON decode and S5 JSON sink.

Decoding is ``from_json`` with an explicit schema (no inference pass over the
data). The sink writes one JSON object per row with ``df.write.json`` -- every
task writes its own part file. The ``{data, meta}`` envelope of the reference
is built only around a page, whose size is capped by the page clamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def decode_json(df: DataFrame, col: str, schema: str | T.DataType) -> DataFrame:
    """Replace the JSON text column ``col`` by its parsed value (permissive: malformed text gives NULLs)."""
    return df.withColumn(col, F.from_json(F.col(col), schema))


def explode_json_array(settings: DataFrame, key: str, element_schema: str) -> DataFrame:
    """JSON-array-valued setting ``key`` as one row per element."""
    arr = F.from_json(F.col("value"), f"array<{element_schema}>")
    return settings.where(F.col("key") == key).select(F.posexplode(arr).alias("pos", "item"))


def pg_text(df: DataFrame) -> DataFrame:
    """Render values the way the database driver hands them to the JSON encoder:
    decimals and timestamps as their text form ('904.30', '2001-07-01 00:00:00'),
    integers, booleans and strings unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


JSON_OPTIONS = {"ignoreNullFields": "false"}  # NULL fields are written as null, as json_encode does


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Distributed JSON-lines sink (non-ASCII text is written as is, NULLs as null)."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)


def page_envelope(page_rows: DataFrame, meta: DataFrame, order: list[Column]) -> DataFrame:
    """``{"success": true, "data": [...], "meta": {...}}`` as one JSON string.

    ``page_rows`` must be a page (at most 100 rows, enforced by the page
    clamp), so numbering it with a single-partition window and collecting it
    into one array is bounded; ``order`` is the page's sort order, kept in
    ``data``. ``meta`` is the one-row result of ``paging.page_meta``.
    """
    cols = page_rows.columns
    ranked = page_rows.withColumn("__rn", F.row_number().over(Window.orderBy(*order)))
    data = ranked.agg(F.array_sort(F.collect_list(F.struct("__rn", F.struct(*cols).alias("row")))).alias("__d"))
    meta_col = meta.select(F.struct(*meta.columns)).scalar()
    doc = F.struct(F.lit(True).alias("success"), F.transform("__d", lambda x: x["row"]).alias("data"),
                   meta_col.alias("meta"))
    return data.select(F.to_json(doc, JSON_OPTIONS).alias("json"))
