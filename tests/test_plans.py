"""Plans stay the ones that scale: push-down, pruning, no pairwise joins."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from evcat.operators import catalogue as cat
from evcat.operators import dedup
from evcat.operators.titles import contained_titles
from evcat.plans import adapt
from evcat.plans.queries import QUERIES
from evcat.sources import files
from tests.test_dedup import sequential


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path_factory.mktemp("events") / "t")
    files.write_events(adapt.catalogue(spark, sf_dir), path)
    return spark.read.parquet(path)


def test_listing_filters_reach_the_scan(written):
    q = cat.CatalogueQuery(start_date=date(1998, 2, 1), mode="online", is_free=True)
    text = plan(cat.page(cat.search(written, q, adapt.NOW), q).select("id", "title"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    for column in ("published_at", "expires_at", "start_at", "mode", "is_free"):
        assert column in pushed.split("PushedFilters")[1], column
    assert "description" not in pushed.split("ReadSchema")[1]


def test_month_folders_are_pruned(written):
    text = plan(written.filter("start_month = '1998-02'"))
    assert "start_month" in text.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_facet_reads_three_columns_and_uses_top_k(written):
    from evcat.operators import facets

    text = plan(facets.localities(written, adapt.NOW))
    assert "TakeOrderedAndProject" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert schema.count(":") == 3


PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["dedup_window", "title_containment", "watchlist_marks", "dashboard_stats", "moderation_preview", "dedup_url"])
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not any(p in text for p in PAIRWISE)


def test_titles_are_joined_by_key_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        titles = spark.createDataFrame([("ab",), ("abc",)], "title string")
        text = plan(contained_titles(titles, titles))
        assert not any(p in text for p in PAIRWISE) and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_group_of_copies_and_hot_title(spark):
    """A third of all rows are copies of one event, another third share a title at distinct times."""
    rows = spark.range(6000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "copy of one event").when(F.col("id") % 3 == 1, "daily meetup").otherwise(F.concat(F.lit("talk "), F.col("id"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") * 977_000_011).alias("us"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), F.col("id"))).otherwise("").alias("url"),
        F.lit(True).alias("publishable"),
    )
    got = {r.seq: r.dup_of for r in dedup.batch_duplicates(rows).collect()}
    assert got == sequential([tuple(r) for r in rows.select("title", "us", "url", "seq", "publishable").collect()])
    assert got[0] is None and got[5997] == 0 and got[1] is None and got[4] == 1
