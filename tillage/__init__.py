"""tillage: marketplace reports and dataset changes as lazy Spark DataFrame jobs.

Sub-packages
------------
sources    table scans, declared schemas, literal seeds, JSON decode/sink
functions  column expressions (labels, codes, slugs, text tokens)
operators  reusable DataFrame -> DataFrame building blocks
           (filters, joins, aggregates, paging, nesting, changes, pricing, quality)
plans      the reports, one function per report, grouped by business area
streaming  incremental form of the stock ledger on Structured Streaming
"""

__all__ = ["session"]
