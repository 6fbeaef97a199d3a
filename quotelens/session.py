"""Spark session helpers.

The library never assumes a machine-local folder on a cluster: the shared
checkpoint folder is read from ``spark.checkpoint.dir``; only when it is unset
(local tests) is a fresh scratch folder created for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale: AQE re-plans joins from runtime sizes, splits
# skewed shuffle partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Runtime SQL settings for a large cluster (AQE sizes partitions from data).
CLUSTER_SQL_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "8192",
}


def configure_for_scale(spark: SparkSession) -> None:
    """Apply the AQE / partition sizing settings above (runtime-settable only)."""
    for k, v in {**SCALE_CONF, **CLUSTER_SQL_CONF}.items():
        spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "quotelens", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # remove reliable checkpoint files once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**SCALE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this application, set up if nobody did.

    A folder set on the context wins, then ``spark.checkpoint.dir``.  Only a
    local master (tests) falls back to a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                # a machine-local folder would not survive the loss of this machine
                raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                                   "distributed file system) before running quotelens on a cluster")
            configured = tempfile.mkdtemp(prefix="quotelens-ckpt-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, apart for every application and call."""
    app = spark.sparkContext.applicationId
    return f"{ensure_checkpoint_dir(spark)}/tables/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write a reused intermediate as parquet in the shared folder and read it back.

    The lineage is cut, column pruning still works on every read, and the
    table survives the loss of any executor.  zstd keeps it small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Wide rows (some 20 columns) that a task sorts or aggregates at a time, under 300 MB of its memory.
ROWS_PER_TASK = 150_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions to deal a table of that many wide rows to: a task's share doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


#: Metadata of a column whose equal values lie in one partition of the written table.
GROUPED = "quotelens.grouped"


def materialize_grouped(df: DataFrame, name: str, key: str, order: list[str], hot_in: DataFrame | None = None,
                        hot_rows: int = 2_000_000, buckets: int | None = None, most: int | None = None) -> DataFrame:
    """Write a table bucketed by ``key`` in the shared folder, so that everything per key needs no exchange.

    A key's rows lie in one bucket, which only suits keys of bounded size: if
    ``hot_in`` (default: the table; its source may be cheaper to count) holds a
    key with ``hot_rows`` rows or more, the table is written as ``materialize``
    does, and the operators take their ways for hot keys.  The column's
    metadata tells which of the two it is (``is_grouped``).  ``buckets`` (default:
    by the rows counted) is the number of partitions if the rows are dealt already.
    ``most`` is a number of rows no key exceeds, if known: where it and ``buckets`` suffice, nothing is counted.
    """
    spark = df.sparkSession
    if not buckets or most is None or most >= hot_rows:
        sizes = (df if hot_in is None else hot_in).groupBy(key).count()
        found = sizes.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
        if (found["most"] or 0) >= hot_rows:
            return materialize(df, name)
        buckets = buckets or partitions_for(spark, found["rows"] or 0)
    table = f"quotelens_{name}_{uuid.uuid4().hex}"
    # no exchange is added where the rows are already dealt like this
    (df.repartition(buckets, key).write.option("compression", "zstd").option("path", scratch_path(spark, name))
     .bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table))
    return spark.table(table).withMetadata(key, {GROUPED: True})


def is_grouped(df: DataFrame, key: str) -> bool:
    return bool(df.schema[key].metadata.get(GROUPED))
