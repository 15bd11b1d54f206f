"""Scalar expressions, JVM-side and inside whole-stage codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# PostgreSQL TO_CHAR patterns used by the reports and their
# Spark datetime-pattern equivalents.
TO_CHAR_PATTERNS = {
    "Mon YYYY": "MMM yyyy",
    "Mon": "MMM",
    "YYYY-MM": "yyyy-MM",
    "Dy": "EEE",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(value: dt.datetime | dt.date) -> Column:
    """A ``timestamp_ntz`` literal (wall-clock time, independent of any time zone)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# E1 -------------------------------------------------------------------------
def to_char(ts: Column | str, pg_pattern: str) -> Column:
    return F.date_format(_c(ts), TO_CHAR_PATTERNS[pg_pattern])


# E2 -------------------------------------------------------------------------
def trunc_ts(ts: Column | str, unit: str) -> Column:
    """``DATE_TRUNC(unit, ts)`` kept as ``timestamp_ntz``."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


# E3 -------------------------------------------------------------------------
def day_of(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def next_day_midnight(d: Column | str) -> Column:
    return F.date_add(_c(d).cast("date"), 1).cast("timestamp_ntz")


# E4 -------------------------------------------------------------------------
def whole_days_until(d: Column | str, as_of: dt.datetime) -> Column:
    """``EXTRACT(DAY FROM d - as_of)::INT``: whole days, fraction dropped toward zero."""
    interval = _c(d).cast("timestamp_ntz") - ntz(as_of)
    return F.extract(F.lit("DAY"), interval).cast("int")


# E5 -------------------------------------------------------------------------
def shifted(as_of: dt.datetime, days: int = 0) -> Column:
    return ntz(as_of + dt.timedelta(days=days))


# E6 -------------------------------------------------------------------------
def full_name(first: Column | str, last: Column | str) -> Column:
    """``first || ' ' || last``: NULL if either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


# E9 -------------------------------------------------------------------------
def code_from_id(prefix: str, id_col: Column | str) -> Column:
    """``prefix || UPPER(SUBSTRING(id::text, 1, 8))``."""
    return F.concat(F.lit(prefix), F.upper(F.substring(_c(id_col).cast("string"), 1, 8)))


# E10 ------------------------------------------------------------------------
def slug(name: Column | str) -> Column:
    """Replace runs of ``[^a-z0-9]`` by '-' first, then lower-case (capitals become '-')."""
    return F.lower(F.regexp_replace(_c(name), "[^a-z0-9]+", "-"))


# PHP ``trim`` strips these.
BLANKS = " \t\n\r\0\x0b"


def php_trim(x: Column | str) -> Column:
    return F.btrim(_c(x), F.lit(BLANKS))


# E11 ------------------------------------------------------------------------
def split_name(x: Column | str) -> tuple[Column, Column]:
    """Split at the first space: (first, rest or '')."""
    parts = F.split(php_trim(x), " ", 2)
    return parts.getItem(0), F.coalesce(F.get(parts, 1), F.lit(""))


# E13 ------------------------------------------------------------------------
def module_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_]", "")


# E14 ------------------------------------------------------------------------
def zero_pad(n: Column | str, width: int) -> Column:
    return F.lpad(_c(n).cast("string"), width, "0")


# E15 ------------------------------------------------------------------------
def money_round(x: Column | str, scale: int = 2) -> Column:
    """Half away from zero on a decimal value (2.345 -> 2.35)."""
    return F.round(_c(x).cast("decimal(38,6)"), scale).cast(f"decimal(38,{scale})")


# E17 ------------------------------------------------------------------------
def address_type(x: Column | str) -> Column:
    t = F.lower(F.coalesce(_c(x), F.lit("home")))
    return (F.when(t.isin("office", "farm", "work"), "work")
            .when(t == "home", "home").otherwise("other"))


# E18 ------------------------------------------------------------------------
def php_int(x: Column | str) -> Column:
    """PHP ``(int)``: leading integer of the trimmed text ('12abc' -> 12), else 0."""
    lead = F.regexp_extract(F.ltrim(_c(x).cast("string")), r"^[+-]?[0-9]+", 0)
    return F.coalesce(lead.try_cast("bigint"), F.lit(0).cast("bigint"))


def php_float(x: Column | str) -> Column:
    """PHP ``(float)``: leading decimal number of the text, else 0.0."""
    lead = F.regexp_extract(F.ltrim(_c(x).cast("string")),
                            r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", 0)
    return F.coalesce(lead.try_cast("double"), F.lit(0.0))


# E19 ------------------------------------------------------------------------
def first_n_positions(arr: Column | str, n: int) -> Column:
    """``array_slice(arr, 0, n)`` with positions: array<struct<pos, value, is_first>>."""
    sliced = F.slice(_c(arr), 1, n)
    return F.transform(sliced, lambda v, i: F.struct(i.alias("pos"), v.alias("value"),
                                                     (i == 0).alias("is_first")))


URL_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+[^\s]*$"


def looks_like_url(x: Column | str) -> Column:
    """Stand-in for PHP ``FILTER_VALIDATE_URL``: scheme://host[rest], no spaces."""
    return _c(x).rlike(URL_PATTERN)
