"""Queries over the event stream: stages of a race and joins within an interval, each with the SQL of a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.plans.base import out, query
from furlong.session import new_path
from furlong.sources.views import table
from furlong.streaming import intervals, stages
from furlong.streaming.sinks import read_stream

SLOT = 3 * 3600


def event_stream(s: SparkSession, d: str) -> DataFrame:
    e = read_stream(s, f"{d}/events.parquet", table(s, d, "events").schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def snapshots(events: DataFrame) -> DataFrame:
    """Races of three hours and of ten groups of users; an event is a snapshot, one of type error a failed one."""
    slot = F.floor(F.unix_seconds("ts") / SLOT) + 1
    return events.select((slot * 10 + F.col("user_id") % 10).alias("race_id"), F.timestamp_seconds(slot * SLOT).alias("start"), F.col("ts").alias("at"), F.col("event_id").alias("ref"), "value", (F.col("event_type") != "error").alias("ok"))


@query("race_stages", f"""WITH s AS (SELECT (floor(epoch(ts) / {SLOT})::BIGINT + 1) * 10 + user_id % 10 AS race_id, (floor(epoch(ts) / {SLOT})::BIGINT + 1) * {SLOT} * 1000 AS start_ms, epoch_ms(ts) AS at_ms, event_id AS ref, value, event_type <> 'error' AS ok FROM events),
 a AS (SELECT *, start_ms - at_ms AS l, (SELECT max(at_ms) FROM s) - 600000 AS passed FROM s WHERE ok AND start_ms > at_ms), u AS (SELECT * FROM a WHERE start_ms < passed),
 f AS (SELECT * FROM u WHERE l <= 1200000 QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY at_ms, ref) = 1),
 p AS (SELECT * FROM a WHERE l <= 3600000 AND start_ms - 1200000 < passed QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY at_ms, ref) = 1),
 l AS (SELECT * FROM u WHERE race_id NOT IN (SELECT race_id FROM f) QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY at_ms DESC, ref DESC) = 1)
 SELECT race_id, stage, ref, round(value, 6) AS value FROM (SELECT *, 'final' AS stage FROM f UNION ALL SELECT *, 'provisional' FROM p UNION ALL SELECT *, 'latest' FROM f UNION ALL SELECT *, 'latest' FROM l)""")  # fmt: skip
def _stages(s: SparkSession, d: str) -> DataFrame:
    found = stages.run_stages(snapshots(event_stream(s, d)), new_path(s, "stages"), new_path(s, "stages-state"))
    return out(found.rows, "ref", "value", keys=["race_id", "stage"])


def ticks(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select(F.col("event_id").alias("tick"), "user_id", F.col("ts").alias("at"))


@query("usable_odds", """WITH t AS (SELECT event_id AS tick, user_id, ts FROM events WHERE event_type = 'purchase'), o AS (SELECT event_id AS odds, user_id, ts FROM events WHERE event_type IN ('click', 'view'))
 SELECT tick, max_by(odds, (o.ts, odds)) AS odds, count(odds) AS n FROM t LEFT JOIN o ON o.user_id = t.user_id AND o.ts BETWEEN t.ts - INTERVAL 15 MINUTE AND t.ts
 WHERE t.ts < (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY GROUP BY 1""")
def _odds(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    odds = event_stream(s, d).where("event_type in ('click', 'view')").select("user_id", F.col("event_id").alias("odds"), F.col("ts").alias("right_at"))
    found = intervals.run_join(intervals.usable_odds(ticks(e), odds, "user_id", "1 hour"), new_path(s, "odds"), new_path(s, "odds-state")).rows
    # the last hour's ticks may still find odds; what the watermark has not passed by a day is left to the next run
    last = table(s, d, "events").where("event_type = 'purchase'").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 day")).alias("end"))
    closed = found.crossJoin(F.broadcast(last)).where(F.col("at") < F.col("end"))  # one row
    best = closed.groupBy("tick").agg(F.max(F.struct("right_at", "odds"))["odds"].alias("odds"), F.count("odds").alias("n"))
    return out(best, "odds", "n", keys=["tick"])


@query("usable_results", """WITH t AS (SELECT event_id AS tick, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS start FROM events WHERE event_type = 'signup')
 SELECT tick, epoch(start)::BIGINT AS start FROM t JOIN r ON r.user_id = t.user_id AND start BETWEEN t.ts - INTERVAL 12 HOUR AND t.ts - INTERVAL 40 MINUTE""")
def _results(s: SparkSession, d: str) -> DataFrame:
    results = event_stream(s, d).where("event_type = 'signup'").select("user_id", F.date_trunc("hour", "ts").alias("right_at"))
    found = intervals.run_join(intervals.usable_results(ticks(event_stream(s, d)), results, "user_id", "2 days"), new_path(s, "results"), new_path(s, "results-state")).rows
    return found.select("tick", F.unix_seconds("right_at").alias("start"))
