"""The stages of a race before its start, from a stream of snapshots: what is the latest, what was shown as provisional, what
is final.

A snapshot counts by the minutes that are left: more than 60 only as the latest, 60 to more than 20 as provisional, 20 to more
than 0 as final. The first usable snapshot of a stage is that stage's and is written once, when the watermark has passed the
stage's end, so the order of arrival within the watermark's delay changes nothing. A snapshot that failed leaves what is there.
Once a race has a final one the later ones are not looked at. A race without a usable snapshot from 60 to 20 minutes before
has its final one as its provisional one too. Snapshots behind the watermark are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from furlong.streaming.sinks import Drained, drain

PROVISIONAL_MINUTES, FINAL_MINUTES = 60, 20
OUT = "race_id long, start_ms long, stage string, at_ms long, ref long, value double"
_SHOT = "at_ms long, ref long, value double"
_MINUTE = 60_000


class Stages(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.provisional = handle.getValueState("provisional", _SHOT)
        self.final = handle.getValueState("final", _SHOT)
        self.latest = handle.getValueState("latest", _SHOT)
        self.shown = handle.getValueState("shown", "stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        start = key[1]
        # a call's rows are put together first, so that each state is read and written once
        provisional = final = latest = None
        for r in rows:
            left = start - r["at_ms"]
            if not r["ok"] or left <= 0:
                continue
            shot = (r["at_ms"], r["ref"], r["value"])
            # ties of time: the lower number is the earlier one
            if left <= FINAL_MINUTES * _MINUTE and (final is None or shot < final):
                final = shot
            if left <= PROVISIONAL_MINUTES * _MINUTE and (provisional is None or shot < provisional):
                provisional = shot
            if latest is None or shot > latest:
                latest = shot
        for state, shot, which in ((self.final, final, min), (self.provisional, provisional, min), (self.latest, latest, max)):
            if shot:
                self._keep(state, shot, which)
        for at in (start - FINAL_MINUTES * _MINUTE, start):
            if at > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(at)
        return iter(())

    @staticmethod
    def _keep(state, shot: tuple, which) -> None:
        state.update(which(tuple(state.get()), shot) if state.exists() else shot)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        race, start = key[0], key[1]
        row = lambda stage, shot: Row(race_id=race, start_ms=start, stage=stage, at_ms=shot[0], ref=shot[1], value=shot[2])
        if expiredTimerInfo.getExpiryTimeInMs() < start:
            if self.provisional.exists():
                self.shown.update(("provisional",))
                yield row("provisional", tuple(self.provisional.get()))
            return
        final = tuple(self.final.get()) if self.final.exists() else None
        if self.provisional.exists() and not self.shown.exists():
            yield row("provisional", tuple(self.provisional.get()))
        if final:
            yield row("final", final)
        if self.latest.exists():
            yield row("latest", final or tuple(self.latest.get()))
        for state in (self.provisional, self.final, self.latest, self.shown):
            state.clear()

    def close(self) -> None:
        pass


def stages(snapshots: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """snapshots: a stream of race_id, start, at (timestamps), ref (number of the snapshot), value and ok."""
    ms = lambda c: F.unix_millis(F.col(c))
    known = snapshots.select("race_id", "start", F.col("at").cast("timestamp").alias("at"), "ref", "value", F.coalesce("ok", F.lit(False)).alias("ok"))
    shaped = known.withWatermark("at", delay).withColumns({"start_ms": ms("start"), "at_ms": ms("at")}).where("race_id is not null and start_ms is not null")
    grouped = shaped.groupBy("race_id", "start_ms")
    return grouped.transformWithState(statefulProcessor=Stages(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_stages(snapshots: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> Drained:
    """Stage rows of all races whose start the watermark has passed."""
    return drain(stages(snapshots, delay), path, checkpoint)


def stages_batch(snapshots: DataFrame) -> DataFrame:
    """The same for a finished table: a slow-path check and a way to fill in history."""
    left = F.unix_millis("start") - F.unix_millis("at")
    usable = snapshots.where(F.col("ok") & (left > 0)).withColumn("_l", left)
    shot = F.struct(F.unix_millis("at").alias("at_ms"), "ref", "value")
    least = lambda m: F.min(F.when(F.col("_l") <= m * _MINUTE, shot))
    best = usable.groupBy("race_id", F.unix_millis("start").alias("start_ms")).agg(least(PROVISIONAL_MINUTES).alias("provisional"), least(FINAL_MINUTES).alias("final"), F.max(shot).alias("last"))
    latest = F.coalesce("final", "last")
    each = F.array(*(F.struct(F.lit(n).alias("stage"), c.alias("shot")) for n, c in (("provisional", F.col("provisional")), ("final", F.col("final")), ("latest", latest))))
    return best.select("race_id", "start_ms", F.explode(each).alias("x")).where("x.shot is not null").select("race_id", "start_ms", "x.stage", "x.shot.*")
