"""Structured Streaming forms: keyed book state, idempotent builds, watermarked windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.replay import EVENT_COLUMNS, QUOTE, SCOPE, ordered, stream_fold


def book_quotes(events: DataFrame, order: str = "usable_time") -> DataFrame:
    """A stream of book events as a stream of quotes. Events of a scope are folded in the order they become available; what comes
    later than its successors is an issue of the fold, not dropped."""
    return ordered(events, order).select(*SCOPE, *EVENT_COLUMNS).groupBy(*SCOPE).applyInPandasWithState(stream_fold, QUOTE, "state string", "append", "NoTimeout")


def candles(events: DataFrame, at: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Open, high, low, close and count of tumbling windows; a window closes once the watermark passes it."""
    first, last = F.min_by(value, at), F.max_by(value, at)
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), *keys)
    return grouped.agg(first.alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last.alias("close"), F.count("*").alias("n"))


def late_rows(events: DataFrame, at: str, watermark: str) -> DataFrame:
    """What a watermark of that instant would drop unseen, counted before the stateful step."""
    return events.where(F.col(at) <= F.lit(watermark).cast("timestamp")).agg(F.count("*").alias("late"))


def builds(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each build once, however often it is swept."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Runs what is available through a callback; the checkpoint makes a restart resume where it ended."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
