"""Queries of the record fields' functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import codes
from furlong.plans.base import out, query
from furlong.sources.views import FIELDS, fields

ROW = ["race_id", "line"]
NUMBER = "CASE WHEN trim({c}) NOT IN ('', {m}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("field_numbers", f"""WITH {FIELDS}, v AS (SELECT *, {NUMBER.format(c='size', m="'000'")} AS n, {NUMBER.format(c='size', m="'999'")} AS d, {NUMBER.format(c='time', m="'0000'")} AS t FROM fields)
 SELECT race_id, line, n AS number, round(n / 10, 6) AS tenths, round(floor(t / 1000) * 60 + (t % 1000) / 10, 6) AS seconds,
 CASE WHEN d = 0 THEN 0.0 WHEN trim(sign) = '+' THEN d WHEN trim(sign) = '-' THEN -d END AS signed FROM v""")  # fmt: skip
def _numbers(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d).withColumns({"number": codes.to_number(F.col("size"), ("000",)), "tenths": codes.to_tenths(F.col("size"), ("000",)), "seconds": codes.race_time(F.col("time")), "signed": codes.signed_difference(F.col("sign"), F.col("size"))})
    return out(f, "number", "tenths", "seconds", "signed", keys=ROW)


@query("field_times", f"""WITH {FIELDS}, v AS (SELECT *, trim(sign || size) AS td FROM fields)
 SELECT race_id, line, CASE WHEN regexp_full_match(td, '[+-][0-9]{{3}}') THEN CASE WHEN td[1] = '-' THEN -1 ELSE 1 END * CAST(td[2:] AS DOUBLE) / 10 + 0 END AS behind,
 CASE WHEN regexp_full_match(hhmm, '[0-9]{{3,4}}') THEN CAST(lpad(hhmm, 4, '0')[1:2] AS BIGINT) * 60 + CAST(lpad(hhmm, 4, '0')[3:4] AS BIGINT) END AS minute,
 strftime(CASE WHEN regexp_full_match(hhmm, '[0-9]{{3,4}}') THEN made + to_minutes(CAST(lpad(hhmm, 4, '0')[1:2] AS BIGINT) * 60 + CAST(lpad(hhmm, 4, '0')[3:4] AS BIGINT)) END, '%Y-%m-%d %H:%M') AS starts FROM v""")  # fmt: skip
def _times(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d)
    return f.select(*ROW, F.round(codes.time_difference(F.concat("sign", "size")), 6).alias("behind"), codes.start_minutes(F.col("hhmm")).cast("long").alias("minute"), F.date_format(codes.post_time(F.col("made"), F.col("hhmm")), "yyyy-MM-dd HH:mm").alias("starts"))


def _in(c: str, values: tuple[int, ...]) -> str:
    return f"{c} IN ({', '.join(map(str, values))})"


@query("field_tracks", f"""WITH {FIELDS}, c AS (SELECT *, TRY_CAST(track AS INT) AS n FROM fields)
 SELECT race_id, line, CASE WHEN n BETWEEN 10 AND 22 THEN 'turf' WHEN {_in('n', codes.DIRT)} THEN 'dirt' WHEN {_in('n', codes.SAND)} THEN 'sand' WHEN n BETWEEN 51 AND 59 THEN 'jump' END AS surface,
 CASE WHEN {_in('n', codes.STRAIGHT)} THEN 'straight' WHEN {_in('n', codes.LEFT)} THEN 'left' WHEN {_in('n', codes.RIGHT)} THEN 'right' END AS turn,
 CASE WHEN {_in('n', codes.OUTER)} THEN 'outer' WHEN {_in('n', codes.IN_TO_OUT)} THEN 'in-out' WHEN {_in('n', codes.OUT_TO_IN)} THEN 'out-in' WHEN {_in('n', codes.STRAIGHT)} THEN NULL WHEN n IS NOT NULL THEN 'inner' END AS course FROM c""")  # fmt: skip
def _tracks(s: SparkSession, d: str) -> DataFrame:
    c = F.col("track")
    return fields(s, d).select(*ROW, codes.track_surface(c).alias("surface"), codes.track_turn(c).alias("turn"), codes.track_course(c).alias("course"))


LEVEL = "CASE WHEN NOT regexp_full_match(trim({c}), '[0-9]+') THEN NULL WHEN {n} IN (701, 702) THEN 0 WHEN {n} = 703 THEN 1 WHEN {n} = 999 THEN 5 WHEN {n} BETWEEN 1 AND 5 THEN 2 WHEN {n} BETWEEN 6 AND 10 THEN 3 WHEN {n} BETWEEN 11 AND 100 THEN 4 END"


@query("field_classes", f"""WITH {FIELDS}, l AS (SELECT *, {LEVEL.format(c='entry', n='TRY_CAST(trim(entry) AS INT)')} AS a, {LEVEL.format(c='entry2', n='TRY_CAST(trim(entry2) AS INT)')} AS b,
 CASE grade_code WHEN 'A' THEN 9 WHEN 'B' THEN 8 WHEN 'C' THEN 7 WHEN 'D' THEN 7 WHEN 'F' THEN 9 WHEN 'G' THEN 8 WHEN 'H' THEN 7 WHEN 'L' THEN 6 END AS g FROM fields)
 SELECT race_id, line, CAST(a AS BIGINT) AS level, CAST(greatest(a, b, g) AS BIGINT) AS class_level FROM l""")  # fmt: skip
def _classes(s: SparkSession, d: str) -> DataFrame:
    return fields(s, d).select(*ROW, codes.condition_level(F.col("entry")).cast("long").alias("level"), codes.class_level([F.col("entry"), F.col("entry2")], F.col("grade_code")).cast("long").alias("class_level"))


@query("field_keys", f"""WITH {FIELDS}, k AS (SELECT *, strftime(made, '%Y') || lpad(CAST(supp % 10 AS VARCHAR), 2, '0') || lpad(CAST(line AS VARCHAR), 2, '0') || lpad(CAST(q % 9 AS VARCHAR), 2, '0') || lpad(CAST(part % 12 AS VARCHAR), 2, '0') AS key FROM fields)
 SELECT race_id, line, key, strftime(made, '%Y%m%d') || key[5:12] AS live, CASE WHEN q % 2 = 0 THEN strftime(made, '%Y-%m-%d') END AS made,
 CAST(CASE WHEN q % 2 = 0 THEN year(made) * 10000 + month(made) * 100 + day(made) ELSE 0 END AS BIGINT) AS number, CAST(part AS VARCHAR) AS id FROM k""")  # fmt: skip
def _keys(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    made = codes.record_date(F.date_format("made", "yyyy"), F.when(F.col("q") % 2 == 0, F.date_format("made", "MMdd")).otherwise("1332"))
    f = fields(s, d).withColumn("key", codes.race_key(F.date_format("made", "yyyy"), text(F.col("supp") % 10), text(F.col("line")), text(F.col("q") % 9), text(F.col("part") % 12)))
    return f.select(*ROW, "key", codes.live_key(F.col("key"), F.col("made")).alias("live"), F.date_format(made, "yyyy-MM-dd").alias("made"), codes.date_number(made).alias("number"), codes.normalized_id(F.col("id")).alias("id"))


@query("field_measures", f"""WITH {FIELDS}, v AS (SELECT *, q / 51 AS p, price / 20 AS stake, least(greatest(q / 51, 1e-6), 1 - 1e-6) AS c FROM fields)
 SELECT race_id, line, round(ln(c / (1 - c)), 6) AS logit, round(1 / (1 + exp(-(q - 25) / 5)), 6) AS sigmoid,
 CAST(CASE WHEN stake <= 2000 THEN 10000 WHEN stake <= 4000 THEN 20000 WHEN stake <= 7500 THEN 30000 ELSE 50000 END AS BIGINT) AS hot,
 round(CASE WHEN q % 5 <> 0 THEN 72.5 / (q % 5 / 60) END, 6) AS estimated,
 round(CASE WHEN line >= 2 THEN (sqrt(1 - pow(0.81, line - 1)) / (1 - pow(0.9, line - 1)) - 1) / (sqrt(19) - 1) * 1200 ELSE 1200 END, 6) AS correction FROM v""")  # fmt: skip
def _measures(s: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    f = fields(s, d).withColumns({"logit": codes.logit(q / 51), "sigmoid": codes.sigmoid((q - 25) / 5), "hot": codes.hot_threshold(F.col("price") / 20), "estimated": codes.estimated_payout((q % 5) / 60, "trifecta"), "correction": codes.performance_correction(F.col("line") - 1)})
    return out(f, "logit", "sigmoid", "hot", "estimated", "correction", keys=ROW)


@query("field_combinations", f"""WITH {FIELDS}, k AS (SELECT *, (part % 18 + 1) * 10000 + (supp % 18 + 1) * 100 + q % 18 + 1 AS code FROM fields)
 SELECT race_id, line, concat_ws('→', part % 18 + 1, supp % 18 + 1, q % 18 + 1) AS ordered, array_to_string(list_sort([part % 18 + 1, supp % 18 + 1, q % 18 + 1]), '-') AS anyhow,
 array_to_string([lpad(CAST(x AS VARCHAR), 2, '0') for x in list_sort([part % 18 + 1, supp % 18 + 1, q % 18 + 1])], '') AS key FROM k""")  # fmt: skip
def _combinations(s: SparkSession, d: str) -> DataFrame:
    code = (F.col("part") % 18 + 1) * 10_000 + (F.col("supp") % 18 + 1) * 100 + F.col("q") % 18 + 1
    c = codes.combination(code, 3)
    return fields(s, d).select(*ROW, codes.combination_text(c, True).alias("ordered"), codes.combination_text(c, False).alias("anyhow"), codes.combination_key(c, False).alias("key"))


@query("field_days", f"""WITH {FIELDS}, s AS (SELECT DISTINCT made, q % 4 AS n FROM fields WHERE q < 20),
 e AS (SELECT DISTINCT made, n, unnest(list_concat([made - 7], CASE WHEN n > 0 THEN [made + CAST(x AS INT) for x in range(0, n)] ELSE [made] END)) AS day FROM s)
 SELECT strftime(made, '%Y-%m-%d') AS made, n, strftime(day, '%Y-%m-%d') AS day FROM e""")  # fmt: skip
def _days(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d).where("q < 20").select("made", (F.col("q") % 4).alias("n")).distinct()
    text = lambda c: F.date_format(c, "yyyyMMdd")
    last = F.when(F.col("n") > 0, F.concat(F.lit("-"), text(F.date_add("made", (F.col("n") - 1).cast("int"))))).otherwise("")
    spec = F.concat(text(F.date_sub("made", 7)), F.lit(", "), text(F.col("made")), last, F.lit(",none"))
    return f.select(F.date_format("made", "yyyy-MM-dd").alias("made"), "n", F.explode(codes.days_of(spec)).alias("day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("field_stages", f"""WITH {FIELDS}, m AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01 12:00:00', TIMESTAMP '1970-01-01 12:00:00' + to_seconds(q * 100 - 600 + part % 60)) AS sec FROM fields)
 SELECT race_id, line, CAST(floor(sec / 60) AS BIGINT) AS minutes, CASE WHEN floor(sec / 60) < 0 THEN 'after' WHEN floor(sec / 60) < 15 THEN 'final' WHEN floor(sec / 60) <= 25 THEN 'provisional' ELSE 'latest' END AS stage FROM m""")  # fmt: skip
def _stages(s: SparkSession, d: str) -> DataFrame:
    now = F.col("made").cast("timestamp_ntz")
    start = now + F.make_dt_interval(secs=(F.col("q") * 100 - 600 + F.col("part") % 60).cast("decimal(18,6)"))
    m = codes.minutes_before(start, now).cast("long")
    return fields(s, d).select(*ROW, m.alias("minutes"), codes.stage(m).alias("stage"))
