"""Session construction and cluster-safe checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Settings for the 100 TB target (spark-submit --conf …). Shuffle partitions
# are sized for the largest shuffle (order lines, ~256 MB per partition) and
# AQE coalesces the smaller stages; broadcast is allowed only for sides whose
# measured size is under the threshold; skewed partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # spark.checkpoint.dir: a shared folder (HDFS / object store) named by the cluster
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tillage") -> SparkSession:
    """Session for tests and the bench (a cluster job gets its session from spark-submit).

    AQE is on so that shuffle partitions are coalesced at runtime, skewed join
    partitions are split, and sort-merge joins whose measured side is small are
    switched to broadcast joins (a size check on real map output, not a guess).
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TILLAGE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_CHECKPOINT_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is used
    as is. Only when it is unset (local tests) is a scratch folder created.
    (A Spark Connect session has no driver context here; the server's
    setting is used as configured.)
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: checkpointing is configured on the server
        return spark.conf.get("spark.checkpoint.dir", "")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = _LOCAL_CHECKPOINT_DIRS.get(sc.applicationId)
        if configured is None:
            configured = tempfile.mkdtemp(prefix="tillage-ckpt-")
            _LOCAL_CHECKPOINT_DIRS[sc.applicationId] = configured
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
