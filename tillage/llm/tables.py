"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local: dict[str, str] = {}
_recording: list[list] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only where it is unset on a local master."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tillage-llm-"))


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``free``: then give back the shuffles that it took."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tillage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recording:
        paths.append(path)
    if free:
        dropped(spark, [])
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list]:
    """The paths of the tables written and the broadcasts made meanwhile, for :func:`dropped` once nothing reads them any more."""
    paths: list = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [p for p in _recording if p is not paths]


def shared_value(spark: SparkSession, value) -> Broadcast:
    """A broadcast that :func:`recorded` keeps: its files stay on all machines until it is destroyed."""
    made = spark.sparkContext.broadcast(value)
    for paths in _recording:
        paths.append(made)
    return made


def dropped(spark: SparkSession, paths: list) -> None:
    """Delete written tables and broadcasts, and have Spark give back the shuffles that no DataFrame names any more."""
    for path in list(paths):
        for others in _recording:  # an outer record must not drop it again
            others[:] = [x for x in others if x is not path]
        if isinstance(path, Broadcast):
            path.destroy()
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()  # the driver's cleaner learns of dead shuffles by garbage collection only


def text_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n`` (null reads as the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def parts_for(spark: SparkSession, units: float, per_part: float) -> int:
    """Partitions of about ``per_part`` units each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units // per_part) + 1)


HOT_KEYS = 10_000


def joined_evenly(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` inner-joined to ``lookup`` (one row a key, ``n_rows``: how many of the ``total`` rows hold it).

    A key with more than a 10,000th of the rows is hot. At most 10,000 keys
    can be, so those are broadcast and their rows stay where they are; the
    others are shuffled, in groups of at most that share. ``rows`` is read
    twice: pass a written table.
    """
    hot = F.col("n_rows") * HOT_KEYS > total
    named = F.broadcast(lookup.where(hot).drop("n_rows"))
    rest = rows.join(F.broadcast(lookup.where(hot).select(*keys)), keys, "left_anti").join(lookup.where(~hot).drop("n_rows"), keys)
    return rows.join(named, keys).unionByName(rest)


def packed(docs: DataFrame, text_col: str, made: tuple[str, ...]) -> tuple[Column, Column, list[Column]]:
    """What a task on texts takes along and how its output gets the columns of ``docs`` back.

    ``text`` as a string, ``row``, a struct of the other columns but those
    named ``made``, and the columns to select from (text, row). A text column
    is thus carried once; one of another type than string stays in ``row``.
    """
    names = [c for c in docs.columns if c not in made]
    once = isinstance(docs.schema[text_col].dataType, T.StringType)
    held = [c for c in names if c != text_col or not once] or [None]
    row = F.struct(*[F.lit(0).alias("none") if c is None else F.col(f"`{c}`") for c in held]).alias("row")
    back = [F.col("text").alias(c) if c == text_col and once else F.col(f"row.`{c}`") for c in names]
    return F.col(f"`{text_col}`").cast("string").alias("text"), row, back


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task; at its end unused memory goes back to the system, as workers live on for other stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
    return run
