"""Relational table scan.

Tables are Parquet; ``spark.read.parquet`` gives a lazy, vectorised scan whose
filters and projections Catalyst pushes into the reader (``PushedFilters`` /
``ReadSchema`` in the plan). A JDBC source is the same DataFrame with a
partitioned read, see :func:`read_jdbc`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of ``{root}/{name}.parquet``; every call lists the files that are there then."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a table for pruned reads: ``partition_by`` (e.g. the order month)
    lets date filters skip whole folders; ``sort_within`` clusters each file on
    a key so Parquet row-group statistics skip row groups for key filters."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_folders(df: DataFrame, path: str, folder: str) -> None:
    """Write ``df`` as it is dealt in partition folders by the column ``folder`` (int). A file without rows in
    folder 0 holds the schema, so that an empty table can be read back."""
    df.write.mode("overwrite").partitionBy(folder).parquet(path)
    none = df.sparkSession.createDataFrame([], df.drop(folder).schema)
    none.coalesce(1).write.mode("append").parquet(f"{path}/{folder}=0")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC scan: ``partitions`` range queries on ``key`` run in parallel."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
