"""Full-text search: term arrays on the catalogue and an inverted index for large ones."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.functions.stem import terms

SEARCHED_COLUMNS = ("title", "short_description", "community_name", "organizer_name", "locality")


def document_text(columns: Sequence[str] = SEARCHED_COLUMNS) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def with_search_tokens(events: DataFrame, stemmed: bool = True, columns: Sequence[str] = SEARCHED_COLUMNS) -> DataFrame:
    """Fill ``search_tokens``; done when the catalogue is written."""
    return events.withColumn("search_tokens", terms(document_text(columns), stemmed))


def matches_all(tokens: Column, wanted: Sequence[str]) -> Column:
    """All terms present. A query without terms (only stop words) matches nothing."""
    if not wanted:
        return F.lit(False)
    hit = F.array_contains(tokens, wanted[0])
    for term in wanted[1:]:
        hit = hit & F.array_contains(tokens, term)
    return F.coalesce(hit, F.lit(False))


def build_index(docs: DataFrame, id_column: str = "id", tokens: str = "search_tokens") -> DataFrame:
    """Inverted index (term, doc)."""
    return docs.select(F.explode(tokens).alias("term"), F.col(id_column).alias("doc"))


def write_index(index: DataFrame, path: str, files: int) -> None:
    """Sorted by term, so a lookup reads few row groups; the document id in the range key lets one
    frequent term spread over many files."""
    index.repartitionByRange(files, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def lookup(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Documents that hold every wanted term."""
    distinct = list(dict.fromkeys(wanted))
    return (
        index.filter(F.col("term").isin(*distinct))
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(distinct))
        .select("doc")
        if distinct
        else index.filter(F.lit(False)).select("doc")
    )
