"""Streaming forms: rows flagged against fixed real rows as they arrive, and mergeable statistics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.neighbours import HELD, any_within


def flag_stream(pool: DataFrame, real_with_radius: DataFrame, key: str, columns: list[str], radius: str = "dist", most_held: int = HELD) -> DataFrame:
    """Flags of a streaming pool: stateless, the real rows being fixed and held on the executors as an index.

    More than most_held distinct real points: use flag_batches.
    """
    return any_within(pool, real_with_radius, key, columns, radius, most_held=most_held)


def flag_batches(pool: DataFrame, real_with_radius: DataFrame, key: str, columns: list[str], write, radius: str = "dist", most_held: int = HELD):
    """A stream writer that flags each micro-batch against real rows of any number and hands (flags, batch number) to write."""
    return pool.writeStream.foreachBatch(lambda rows, number: write(any_within(rows, real_with_radius, key, columns, radius, most_held=most_held), number))


def windowed_moments(events: DataFrame, ts: str, column: str, every: str, late: str, by: list[str] | None = None) -> DataFrame:
    """(window, by..., n, mean, std): population moments in event-time windows; rows later than `late` are dropped by the watermark."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, every), *(by or []))
    return grouped.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
