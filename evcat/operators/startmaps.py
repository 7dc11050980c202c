"""Changes of a start as maps that compose.

An offer n moves a start s to n when s is special (close to the publishing time, or a placeholder) or at least six hours away, and else
leaves it. As a function of s an offer is the identity on one interval and constant beside it, and so is any sequence of offers: the
identity on the intersection, constants on the steps beside it, one constant for the special starts. Such maps compose, so a stretch of
the offers of an event is one small map, and stretches are chained without looking at their offers again.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.operators.ordered import ROWS_PER_SLICE
from evcat.session import cut

_SECOND = 1_000_000
_NEAR, _FAR = 120 * _SECOND, 6 * 3600 * _SECOND
# From this start on a date counts as a placeholder.
_DEFAULTED_US = int(datetime(C.DEFAULTED_YEAR, 1, 1, tzinfo=timezone.utc).timestamp()) * _SECOND
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


class StartMap:
    """What a sequence of offers does to any start of an event."""

    def __init__(self, published: int | None):
        self.published = published
        self.low, self.high = _LOWEST, _HIGHEST  # starts from low to high stay
        self.special: int | None = None  # where special starts go, None before the first offer
        self.left: list[tuple[int, int]] = []  # (last start, goes to), ascending, below low
        self.right: list[tuple[int, int]] = []  # (minus first start, goes to), ascending, above high

    def is_special(self, start: int) -> bool:
        return start >= _DEFAULTED_US or (self.published is not None and abs(start - self.published) < _NEAR)

    def _moved(self, start: int, offer: int) -> int:
        return offer if self.is_special(start) or abs(start - offer) >= _FAR else start

    def _merged(self, steps: list[tuple[int, int]], offer: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for edge, value in steps:
            value = self._moved(value, offer)
            if out and out[-1][1] == value:
                out[-1] = (edge, value)
            else:
                out.append((edge, value))
        return out

    def offer(self, new: int) -> None:
        """One more offer after all before."""
        self.special = new if self.special is None else self._moved(self.special, new)
        self.left, self.right = self._merged(self.left, new), self._merged(self.right, new)
        low, high = new - _FAR + 1, new + _FAR - 1
        if self.low > self.high:
            return
        if low > self.high or high < self.low:
            self._step(self.left, self.high, new)
            self.low = self.high + 1
            return
        if low > self.low:
            self._step(self.left, low - 1, new)
            self.low = low
        if high < self.high:
            self._step(self.right, -(high + 1), new)
            self.high = high

    @staticmethod
    def _step(steps: list[tuple[int, int]], edge: int, value: int) -> None:
        if steps and steps[-1][1] == value:
            steps[-1] = (edge, value)
        else:
            steps.append((edge, value))

    def __call__(self, start: int) -> int:
        if self.is_special(start):
            return start if self.special is None else self.special
        if self.low <= start <= self.high:
            return start
        steps, key = (self.left, start) if start < self.low else (self.right, -start)
        return steps[bisect_left(steps, (key, _LOWEST))][1]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The maps of the events of a sorted slice; only the first and last event may go on in other slices, the others are applied at once."""
    place, current, made, number, start = TaskContext.get().partitionId(), None, None, -1, 0
    columns = ["id", "slice", "whole", "start_us", "published_us", "moved_us", "low", "high", "special", "left", "right"]

    def row(whole: bool) -> tuple:
        if whole:
            return current, place, True, start, made.published, made(start), None, None, None, None, None
        steps = [[{"edge": e, "value": v} for e, v in side] for side in (made.left, made.right)]
        return current, place, False, start, made.published, None, made.low, made.high, made.special, *steps

    for batch in batches:
        out = []
        for id_, first, published, new in zip(batch["id"], batch["start_us"], batch["published_us"], batch["new_us"]):
            if id_ != current:
                if current is not None:
                    out.append(row(whole=number > 0))
                current, start, number = id_, int(first), number + 1
                made = StartMap(None if pd.isna(published) else int(published))
            made.offer(int(new))
        yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("published_us", "moved_us", "low", "high", "special")})
    if current is not None:
        yield pd.DataFrame([row(whole=False)], columns=columns).astype({c: "Int64" for c in ("published_us", "moved_us", "low", "high", "special")})


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The maps of an event one after the other; rows come sorted by event and slice."""
    current, at = None, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.id != current:
                current, at = r.id, int(r.start_us)
            made = StartMap(None if pd.isna(r.published_us) else int(r.published_us))
            made.low, made.high, made.special = int(r.low), int(r.high), None if pd.isna(r.special) else int(r.special)
            made.left, made.right = [[(s["edge"], s["value"]) for s in side] for side in (r.left, r.right)]
            at = made(at)
            out.append((r.id, r.slice, at))
        yield pd.DataFrame(out, columns=["id", "slice", "moved_us"])


_STEPS = "array<struct<edge: bigint, value: bigint>>"


def chained(offers: DataFrame, slices: int | None = None) -> DataFrame:
    """(id, start_us, moved_us): where the offers of each event, in the order of ``seq``, bring its start.

    ``offers`` has id, seq, start_us, published_us (may be null) and new_us. Rows are ranged by event and order, so a busy event spreads
    over slices; each slice gives one row per event, and the maps of an event over several slices, one a slice, are chained.
    """
    rows = cut(offers.select("id", "seq", "start_us", "published_us", "new_us"))
    slices = slices or max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_SLICE))
    ranged = rows.repartitionByRange(slices, "id", "seq").sortWithinPartitions("id", "seq")
    schema = f"id string, slice int, whole boolean, start_us bigint, published_us bigint, moved_us bigint, low bigint, high bigint, special bigint, left {_STEPS}, right {_STEPS}"
    maps = cut(ranged.mapInPandas(_fold, schema))
    edges = maps.filter("NOT whole").repartition("id").sortWithinPartitions("id", "slice")
    last = edges.mapInPandas(_chain, "id string, slice int, moved_us bigint").groupBy("id").agg(F.max_by("moved_us", "slice").alias("moved_us"))
    known = maps.filter("NOT whole").groupBy("id").agg(F.first("start_us").alias("start_us"))
    return maps.filter("whole").select("id", "start_us", "moved_us").unionByName(last.join(known, "id"))
