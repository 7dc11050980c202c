"""Materialised frames and the numbering of all rows."""
from pyspark.sql import functions as F

from evcat.operators import ordered
from evcat.session import cut


def test_cut_reads_only_the_columns_asked_for(spark):
    frame = cut(spark.range(50).select(F.col("id"), F.repeat(F.lit("x"), 500).alias("body"), F.lit(None).alias("nothing")))
    assert dict(frame.dtypes)["nothing"] == "void" and frame.filter("nothing IS NULL AND length(body) = 500").count() == 50
    plan = frame.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "body" not in plan


def test_all_rows_are_numbered_without_another_exchange_of_the_rows(spark):
    rows = spark.range(300).select(F.pmod(F.col("id") * 7, F.lit(300)).alias("at"), F.lit("x").alias("body"))
    out = ordered.add_row_number(rows, [], ["at"], "seq")
    assert all(r["seq"] == r["at"] + 1 for r in out.collect()) and out.count() == 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan
    assert ordered.add_row_number(rows.limit(0), [], ["at"], "seq").count() == 0
