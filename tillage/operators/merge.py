"""M1, M3, M5 on stored tables: only the partitions that a change set names are read and rewritten.

A stored table is dealt to partition folders by a hash of its key. A batch of
changes names some keys, hence some folders: those are read, the change job
runs on them, and a dynamic partition overwrite replaces them. All other files
stay as they are, so a day's changes cost what they touch, not what is stored.
The new folders are staged and moved in when the job has ended; a lost
executor's tasks run again, and until then the old rows are what is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.sources.tables import write_folders

PART = "part"


@dataclass(frozen=True)
class KeyedTable:
    """A table in folders by hash of ``keys``; more ``parts`` touch less per batch and make smaller files."""

    path: str
    keys: tuple[str, ...]
    parts: int = 256

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(PART)

    def create(self, df: DataFrame) -> "KeyedTable":
        write_folders(self._placed(df), self.path, PART)
        return self

    def _placed(self, df: DataFrame) -> DataFrame:
        """Each folder's rows in one task; they are many only where the table repeats keys."""
        return df.withColumn(PART, self._part()).repartition(min(self.parts, 20_000), PART).sortWithinPartitions(PART, *self.keys)

    def touched(self, changes: DataFrame) -> list[int]:
        """The folders of the keys that ``changes`` (with the table's key columns) names: at most ``parts`` numbers."""
        return sorted(r[0] for r in changes.select(self._part()).distinct().collect())

    def merge(self, changes: DataFrame, job: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched folders by ``job(their rows, changes)`` and return their numbers.

        The job must give the rows of these keys only and leave at least one row in every folder that it was given
        rows of, as upserts, backfills and patches do: an emptied folder would not be replaced, so it is refused.
        Key columns have the types of the table's (their hashes name the folders). No changes: nothing is written."""
        parts = self.touched(changes)
        if parts:
            stored = changes.sparkSession.read.parquet(self.path).where(F.col(PART).isin(*parts))
            new = job(stored.drop(PART), changes)
            emptied = stored.select(PART).distinct().join(new.select(self._part().alias(PART)).distinct(), PART, "left_anti")
            if emptied.limit(1).count():
                raise ValueError("the job empties a folder; write the table anew instead")
            self._placed(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        return parts
