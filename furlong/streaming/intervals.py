"""Joining two streams by key within an interval of time, with bounded state and late rows counted.

Each side has a watermark, so a row is kept only as long as the other side can still send a partner. Repeated deliveries of a
right row are dropped for as long as the watermark's delay, so its first arrival counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.streaming.sinks import Drained, drain

#: Odds older than this at the time of use are not used; results can be used so long after the start of their race.
STALE_MINUTES, RESULT_MINUTES = 15, 40


def interval_join(left: DataFrame, right: DataFrame, key: str, earliest: str, latest: str, delay: str, how: str = "inner", delivered: list[str] | None = None) -> DataFrame:
    """left (key, at, ...) with the rows of right (key, right_at, ...) for which right_at is from at - earliest to at - latest.

    earliest, latest: intervals as "15 minutes". how: inner, or leftOuter, which gives a left row without a partner once none
    can come. delivered: columns by which repeated deliveries of right rows are told. Rows without a key or a time join none.
    """
    right = right.withWatermark("right_at", delay)
    if delivered:
        right = right.dropDuplicatesWithinWatermark(delivered)
    right = right.withColumnRenamed(key, "_key")
    at, other = F.col("at"), F.col("right_at")
    near = (F.col(key) == F.col("_key")) & (other >= at - F.expr(f"interval {earliest}")) & (other <= at - F.expr(f"interval {latest}"))
    return left.withWatermark("at", delay).join(right, near, how).drop("_key")


def usable_odds(ticks: DataFrame, odds: DataFrame, key: str, delay: str) -> DataFrame:
    """Every tick with the odds of the quarter of an hour before it; nulls where there are none."""
    return interval_join(ticks, odds, key, f"{STALE_MINUTES} minutes", "0 minutes", delay, "leftOuter")


def usable_results(ticks: DataFrame, results: DataFrame, key: str, delay: str, longest: str = "12 hours") -> DataFrame:
    """Every tick with the results whose race started 40 minutes to ``longest`` before it, however often they were sent."""
    return interval_join(ticks, results, key, longest, f"{RESULT_MINUTES} minutes", delay, "inner", [key, "right_at"])


def run_join(joined: DataFrame, path: str, checkpoint: str) -> Drained:
    return drain(joined, path, checkpoint)
