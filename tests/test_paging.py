from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evcat.operators.paging import SortedTable, admin_order, listing_order

START = datetime(2026, 1, 1)
SCHEMA = "id string, date_tba boolean, start_at timestamp, mode string"


def rows(n):
    """Ties, nulls in every order column but the id, and one mode of a tenth."""
    return [
        (f"{k:05d}", None if k % 13 == 0 else k % 5 == 0, None if k % 7 == 0 else START + timedelta(hours=k % 40), "rare" if k % 10 == 3 else "other")
        for k in range(n)
    ]


@pytest.mark.parametrize("order", [listing_order, admin_order])
@pytest.mark.parametrize("keep", [None, lambda df: df.filter("mode = 'rare'"), lambda df: df.filter("mode = 'none'")])
def test_pages_equal_offset(spark, tmp_path, order, keep):
    events = spark.createDataFrame(rows(700), SCHEMA)
    table = SortedTable.write(events, str(tmp_path / "t"), order(), slice_rows=100, block_rows=16)
    found = (keep(events) if keep else events).orderBy(*order())
    ids = [r.id for r in found.collect()]
    assert table.total(keep) == len(ids)
    limit = 23
    for number in (1, 2, 3, 4, len(ids) // limit, len(ids) // limit + 1, len(ids) // limit + 2, 10**9):
        if number:
            assert [r.id for r in table.page(number, limit, keep).collect()] == ids[(number - 1) * limit : number * limit]
    assert [r.id for r in table.page(1, 1000, keep).collect()] == ids


def test_a_deep_page_reads_the_files_of_its_rows(spark, tmp_path):
    events = spark.range(120_000).select(
        F.format_string("%09d", "id").alias("id"), F.lit(False).alias("date_tba"), F.timestamp_seconds(F.col("id")).alias("start_at"), F.lit("x").alias("mode")
    )
    table = SortedTable.write(events, str(tmp_path / "t"), listing_order(), slice_rows=2_000)
    assert len(table.counts()) >= 50
    deep = table.page(100_000, 1)
    assert [r.id for r in deep.collect()] == ["000099999"]
    assert len(deep.inputFiles()) == 1
    assert len(table.page(5_000, 20).inputFiles()) <= 2


def test_empty_table_and_bad_numbers(spark, tmp_path):
    table = SortedTable.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), listing_order())
    assert table.total() == 0 and table.page(1, 20).columns == ["id", "date_tba", "start_at", "mode"] and table.page(3, 20).count() == 0
    with pytest.raises(ValueError):
        table.page(0, 20)
