"""Session settings, shared work folder and lineage cuts."""
from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import evcat

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    # Batch functions travel with the plan, so executors need no copy of the package.
    cloudpickle.register_pickle_by_value(evcat)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "evcat") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Test tables are small but the work per row is not: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="evcat-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared work folder."""
    return f"{work_dir(spark).rstrip('/')}/evcat-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder; later reads do not recompute it.

    Compressed columns: a checkpoint stores whole uncompressed rows, many times the size, and reads all of their columns again.
    """
    path = run_folder(df.sparkSession, "cut")
    # Parquet has no column without a type; such a column holds nothing but nulls.
    kept = [f for f in df.schema.fields if f.dataType.typeName() != "void"]
    if len(kept) < len(df.columns):
        written = cut(df.select(*[F.col(f"`{f.name}`") if f in kept else F.lit(False).alias(f.name) for f in df.schema.fields]))
        return written.select(*[F.col(f"`{f.name}`") if f in kept else F.lit(None).alias(f.name) for f in df.schema.fields])
    spark, shuffled = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(shuffled, "false")
    # What the write shuffled is of no use behind it; otherwise it stays until the driver collects its garbage.
    spark.conf.set(shuffled, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(shuffled, before)
    return spark.read.schema(df.schema).parquet(path)


# A broadcast table is held by every executor; rows here are narrow (keys and a few short fields).
BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a frame whose size was checked; above the bound it joins by shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def instant(at: datetime) -> Column:
    """Literal for a point in time, taken as UTC when naive.

    A zone-less literal keeps parquet push-down for zone-less columns and folds to TIMESTAMP
    (session zone UTC) against zoned ones.
    """
    utc = at.astimezone(timezone.utc) if at.tzinfo else at
    return F.expr(f"TIMESTAMP_NTZ'{utc.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def zoneless(df: DataFrame) -> DataFrame:
    """Cast zoned timestamps to zone-less UTC for export."""
    return df.select(
        *[
            F.col(f"`{name}`").cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
