"""

Each module exposes report functions ``(catalog-or-DataFrames, params) -> DataFrame``
and a ``REGISTRY`` list of ``Registered`` entries: the query run by the
driver (whole tables, fixed parameters) and its DuckDB oracle text.
"""
