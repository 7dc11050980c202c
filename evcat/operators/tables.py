"""Table maintenance on files: upsert, patch, delete. Each returns the new version of the table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_row(columns: Sequence[str], order: Sequence[str]) -> Column:
    """Aggregate: the row with ``columns`` that comes last by ``order``; a row that is all order is held once."""
    return F.max(F.struct(*order)) if set(columns) <= set(order) else F.max_by(F.struct(*columns), F.struct(*order))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; an aggregate, so copies shrink before the shuffle."""
    picked = df.groupBy(*keys).agg(last_row([c for c in df.columns if c not in keys], order).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def last_per_key(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key for edits that come as a table: the last by ``order``, then by the values themselves, so that the
    physical order of rows decides nothing."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return latest_per_key(df, [key], by_values(df, rest, order))


def by_values(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ()) -> list[str]:
    """``order``, then the other columns that can be compared."""
    return [*order, *[c for c in columns if c not in order and sortable(df, c)]] or list(columns)


def sortable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.simpleString().startswith(("map", "variant"))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Replace rows with equal keys and add the rest; a null in the last key always adds.

    ``keep`` names columns whose existing value survives an update (an id, say).
    """
    nullable = keys[-1]
    keyed = latest_per_key(updates.filter(F.col(nullable).isNotNull()), keys, order)
    loose = updates.filter(F.col(nullable).isNull())
    untouched = target.join(keyed.select(*keys), list(keys), "left_anti")
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        merged = keyed.join(old, list(keys), "left")
        keyed = merged.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in updates.columns])
    return untouched.unionByName(keyed).unionByName(loose)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Add rows whose key is not there yet; among new rows with one key, the first by all columns."""
    first = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_row"))
    flat = first.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in rows.columns])
    return target.unionByName(flat.join(target.select(key), key, "left_anti").select(*target.columns))


def delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def patch(
    target: DataFrame,
    patches: DataFrame,
    fields: Sequence[str],
    key: str = "id",
    guard: Column | None = None,
    stamp: dict[str, Column] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Apply per-row patches: null leaves a field unchanged, fields outside ``fields`` are ignored.

    Of several patches for one key the last by ``order`` (columns of ``patches``) counts. ``guard`` restricts which rows accept a patch; ``stamp`` sets columns on every patched row.
    """
    given = [f for f in fields if f in patches.columns]
    only = last_per_key(patches.select(key, *given, *[c for c in order if c not in given]), key, order)
    news = only.select(key, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in given])
    joined = target.join(news, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if guard is not None:
        hit = hit & F.coalesce(guard, F.lit(False))
    stamp = stamp or {}

    def value(c: str) -> Column:
        if c in given:
            return F.when(hit, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c))
        if c in stamp:
            return F.when(hit, stamp[c]).otherwise(F.col(c))
        return F.col(c)

    return joined.select(*[value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
