"""Reading and writing tables: any Hadoop path, or a database through JDBC."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_events(events: DataFrame, path: str) -> None:
    """Catalogue files by start month, so date filters prune folders and row groups.

    The range key continues below the month, so one busy month spreads over several tasks.
    """
    month = F.coalesce(F.date_format("start_at", "yyyy-MM"), F.lit("none"))
    dated = events.withColumn("start_month", month)
    dated.repartitionByRange("start_month", "start_at", "id").sortWithinPartitions("start_month", "start_at").write.mode(
        "overwrite"
    ).partitionBy("start_month").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_json_pages(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Whole files as JSON pages of one static source."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(source_id).alias("source_id"),
        F.input_file_name().alias("url"),
        F.col("value").alias("html_or_json"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.lit(200).alias("status_code"),
        F.lit("api_response").alias("page_type"),
    )


def config_pages(sources: DataFrame, fetched_at: str | None = None) -> DataFrame:
    """JSON pages of static sources: the event list inside their own config."""
    at = F.expr(f"TIMESTAMP'{fetched_at}'") if fetched_at else F.current_timestamp()
    listed = F.get_json_object("config_json", "$.events")
    return sources.filter((F.col("platform") == "static") & listed.isNotNull()).select(
        F.col("id").alias("source_id"),
        F.coalesce("base_url", F.lit("static://events")).alias("url"),
        F.concat(F.lit('{"results":'), listed, F.lit("}")).alias("html_or_json"),
        at.alias("fetched_at"),
        F.lit(200).alias("status_code"),
        F.lit("api_response").alias("page_type"),
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Database table in ``partitions`` parallel range reads."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=str(partitions), **options,
        )
        .load()
    )


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
