"""Input tables and shared folders of the queries in this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat.session import configure, work_dir


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """Unused folder below the shared work folder."""
    return f"{work_dir(spark).rstrip('/')}/evcat-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, keeps column pruning, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def broadcast_if_bytes(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a written table whose values were measured; a larger one joins by shuffle."""
    width = sum((F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in df.columns), F.lit(16 * len(df.columns)))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
