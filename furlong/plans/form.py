"""Queries of running styles, pace and class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.operators import levels, pace, past, style
from furlong.plans.base import out, query, settle, settle_sql
from furlong.sources.views import RUNS, runs, table

H = "PARTITION BY horse_id"
ROW = "ORDER BY day, race_id, post_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
DAY = "ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LAST = "ORDER BY day, race_id, post_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"

# Passing orders out of order keys, some broken or repeated.
ORDERS_SQL = """ord AS (SELECT o_orderkey AS race_id, k, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE
   '(*' || (k % 18 + 1) || ',' || (k % 7 + 1) || CASE WHEN k % 5 = 0 THEN '' ELSE ')' END || (k % 9 + 10) || ',' || (k % 4 + 3) || CASE WHEN k % 3 = 0 THEN '-(' || (k % 6 + 5) || '=' || (k % 16 + 2) || ')' ELSE '' END || '^' || (k % 10 + 8) END AS c1,
   (k % 5 + 1) || ',' || (k % 3 + 1) || ',(' || (k % 8 + 4) || ',' || (k % 6 + 9) AS c2
  FROM (SELECT o_orderkey, o_orderkey * 7 + o_custkey AS k FROM orders))"""


def orders(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") * 7 + F.col("o_custkey")
    t = lambda m, a: (k % m + a).cast("string")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    first = c("(*", t(18, 1), ",", t(7, 1), F.when(k % 5 == 0, "").otherwise(")"), t(9, 10), ",", t(4, 3), F.when(k % 3 == 0, c("-(", t(6, 5), "=", t(16, 2), ")")).otherwise(""), "^", t(10, 8))
    second = c(t(5, 1), ",", t(3, 1), ",(", t(8, 4), ",", t(6, 9))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("race_id"), F.when(k % 13 == 0, None).when(k % 11 == 0, "").otherwise(first).alias("c1"), second.alias("c2"))


@query("corner_ranks", f"""WITH {ORDERS_SQL}, l AS (SELECT race_id, 1 AS corner, c1 AS t FROM ord UNION ALL SELECT race_id, 2, c2 FROM ord),
 x AS (SELECT race_id, corner, regexp_extract_all(t, '[()]|[0-9]+') AS a FROM l WHERE t IS NOT NULL), tok AS (SELECT race_id, corner, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM x),
 p AS (SELECT *, max(CASE WHEN t = '(' THEN i END) OVER w AS o, max(CASE WHEN t = ')' THEN i END) OVER w AS c,
   min(CASE WHEN t IN ('(', ')') THEN i * 2 + CASE WHEN t = '(' THEN 1 ELSE 0 END END) OVER (PARTITION BY race_id, corner ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
   FROM tok WINDOW w AS (PARTITION BY race_id, corner ORDER BY i)),
 g AS (SELECT *, o IS NOT NULL AND (c IS NULL OR o > c) AS inside FROM p), k AS (SELECT *, CAST(t AS INT) AS post_no, CASE WHEN inside THEN o ELSE i END AS b FROM g WHERE t NOT IN ('(', ')') AND NOT (inside AND coalesce(nxt % 2 = 1, false))),
 f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY race_id, corner, post_no ORDER BY i) = 1)
 SELECT f.race_id, CAST(f.corner AS BIGINT) AS corner, CAST(f.post_no AS BIGINT) AS post_no, (SELECT count(*) FROM k WHERE k.race_id = f.race_id AND k.corner = f.corner AND k.i < f.b) + 1 AS rank FROM f""")  # fmt: skip
def _corner(s: SparkSession, d: str) -> DataFrame:
    return out(style.corner_ranks(orders(s, d), "race_id", ["c1", "c2"]), "corner", "post_no", "rank", keys=["race_id"])


POS_SQL = f"""{RUNS}, c0 AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY horse_id, post_no) AS corner_rank, count(*) OVER (PARTITION BY race_id) AS field FROM runs),
 pos AS (SELECT *, CASE WHEN field > 1 THEN (corner_rank - 1) / (field - 1) END AS pos, CASE WHEN field > 1 THEN (finish_rank - 1) / (field - 1) END AS rel FROM c0)"""
STYLE_SQL = f"""{POS_SQL}, st AS (SELECT *, avg(pos) OVER ({H} {ROW}) AS style FROM pos), nm AS (SELECT *, CASE WHEN round(style, 9) < 0.10 THEN 'front' WHEN round(style, 9) < 0.35 THEN 'stalker' WHEN round(style, 9) < 0.70 THEN 'mid' WHEN style IS NOT NULL THEN 'closer' END AS style_name FROM st)"""


def positions(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("race_id")
    r = runs(s, d).withColumns({"corner_rank": F.row_number().over(w.orderBy("horse_id", "post_no")), "field": F.count("*").over(w)})
    return r.withColumns({"pos": style.relative(F.col("corner_rank"), F.col("field")), "rel": style.relative(F.col("finish_rank"), F.col("field"))})


@query("running_style", f"""WITH {STYLE_SQL} SELECT race_id, post_no, {settle_sql('style')} AS style, CASE WHEN count(pos) OVER r >= 2 THEN {settle_sql('stddev_pop(pos) OVER r')} END AS style_spread, count(pos) OVER r AS style_n,
 {settle_sql('avg(pos) OVER (' + H + ' ' + LAST.format(n=3) + ')')} AS style_last3, round(lag(pos) OVER ({H} ORDER BY day, race_id, post_no), 6) AS style_previous, {settle_sql('avg(pos) FILTER (finish_rank <= 3) OVER r')} AS style_placed, style_name
 FROM nm WINDOW r AS ({H} {ROW})""")  # fmt: skip
def _style(s: SparkSession, d: str) -> DataFrame:
    return out(style.running_style(positions(s, d), "pos"), "style", "style_spread", "style_n", "style_last3", "style_previous", "style_placed", "style_name", settled=("style", "style_spread", "style_last3", "style_placed"))


SCENE_SQL = f"""{STYLE_SQL}, sc AS (SELECT *, sum(CASE WHEN style_name = 'front' THEN 1 ELSE 0 END) OVER w AS fronts, sum(CASE WHEN style_name = 'stalker' THEN 1 ELSE 0 END) OVER w AS stalkers,
 CASE WHEN max(post_no) OVER w > 1 THEN (post_no - 1) / (max(post_no) OVER w - 1) END AS post, avg(style) OVER w AS mean_style FROM nm WINDOW w AS (PARTITION BY race_id)),
 scene AS (SELECT *, (fronts + 0.5 * stalkers) / field AS pressure FROM sc)"""


@query("pace_scenario", f"""WITH {SCENE_SQL} SELECT race_id, post_no, CAST(fronts AS BIGINT) AS fronts, CAST(stalkers AS BIGINT) AS stalkers, CASE WHEN style IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY round(style, 9) NULLS LAST) END AS style_rank,
 {settle_sql('style - mean_style')} + 0 AS style_gap, CAST(CASE WHEN fronts = 1 AND style_name = 'front' THEN 1 ELSE 0 END AS BIGINT) AS lone_front, {settle_sql('pressure')} AS pressure, round(post, 6) AS post,
 {settle_sql('post * style')} AS post_style, {settle_sql('(1 - post) * (1 - style)')} AS inside_front, {settle_sql('distance / 1000 * style')} AS distance_style FROM scene""")  # fmt: skip
def _scenario(s: SparkSession, d: str) -> DataFrame:
    found = style.pace_scenario(style.running_style(positions(s, d), "pos")).withColumn("style_gap", settle(F.col("style_gap")))
    return out(found, "fronts", "stalkers", "style_rank", "style_gap", "lone_front", "pressure", "post", "post_style", "inside_front", "distance_style", settled=("pressure", "post_style", "inside_front", "distance_style"))


@query("official_style", f"""WITH {RUNS}, c AS (SELECT *, jockey_id % 6 AS code, CASE WHEN jockey_id % 6 BETWEEN 1 AND 4 THEN jockey_id % 6 END AS v FROM runs),
 o AS (SELECT *, avg(v) OVER r AS m, avg(CASE WHEN v = 1 THEN 1 WHEN v IS NOT NULL THEN 0 END) OVER r AS f, avg(CASE WHEN v = 4 THEN 1 WHEN v IS NOT NULL THEN 0 END) OVER r AS g, lag(v) OVER ({H} ORDER BY day, race_id, post_no) AS p FROM c WINDOW r AS ({H} {ROW}))
 SELECT race_id, post_no, round(m, 6) AS official_mean, round(f, 6) AS official_front, round(g, 6) AS official_closing, p AS official_previous, round(m - avg(m) OVER (PARTITION BY race_id), 6) + 0 AS official_gap FROM o""")  # fmt: skip
def _official(s: SparkSession, d: str) -> DataFrame:
    found = style.official_style(runs(s, d).withColumn("code", F.col("jockey_id") % 6), "code").withColumn("official_gap", F.round("official_gap", 6) + 0.0)
    return out(found, "official_mean", "official_front", "official_closing", "official_previous", "official_gap")


LAPS_SQL = f"""{RUNS}, lp AS (SELECT race_id, list(CASE WHEN CAST(round((win_odds - 1) * 10) AS BIGINT) % 10 = 0 THEN 0.0 ELSE win_odds + 9 END ORDER BY post_no) AS laps FROM runs GROUP BY 1),
 fl AS (SELECT race_id, [CASE WHEN x > 0 THEN x ELSE 0.0 END for x in laps] AS f, len([x for x in laps if x > 0]) AS n FROM lp),
 pc AS (SELECT race_id, n AS n_laps, CASE WHEN n >= 3 THEN list_sum(f[1:3]) END AS first3, CASE WHEN n >= 3 THEN list_sum(f[n - 2:n]) END AS last3, CASE WHEN n > 0 THEN list_sum(f) END AS total FROM fl)"""


def race_laps(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    lap = F.when(F.round((F.col("win_odds") - 1) * 10).cast("long") % 10 == 0, 0.0).otherwise(F.col("win_odds") + 9)
    # a race's runners are bounded by the rules of racing
    return r.groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("post_no", lap.alias("v")))), lambda x: x["v"]).alias("laps"))


@query("race_pace", f"WITH {LAPS_SQL} SELECT race_id, n_laps, round(first3, 6) AS first3, round(last3, 6) AS last3, round(total, 6) AS total, round(first3 - last3, 6) + 0 AS pace FROM pc")
def _race_pace(s: SparkSession, d: str) -> DataFrame:
    running = race_laps(s, d).withColumn("running", F.transform("laps", lambda x, i: F.aggregate(F.slice("laps", 1, i + 1), F.lit(0.0), lambda a, b: a + b)))
    found = pace.sectionals(running.withColumn("laps", F.transform(pace.laps_of(F.col("running")), lambda x: F.round(x, 9))), "laps").withColumn("pace", F.round("pace", 6) + 0.0)
    return out(found, "n_laps", "first3", "last3", "total", "pace", keys=["race_id"])


PACE_SQL = f"""{LAPS_SQL}, rp AS (SELECT r.*, CAST(floor(distance / 400) AS BIGINT) AS band, first3 - last3 AS pace FROM runs r LEFT JOIN pc USING (race_id)),
 rf AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY post_no) = 1),
 rz AS (SELECT race_id, CASE WHEN count(*) OVER w >= 30 AND pace IS NOT NULL THEN (pace - sum(pace) OVER w / count(*) OVER w) / nullif(sqrt(greatest(sum(pace * pace) OVER w / count(*) OVER w - pow(sum(pace) OVER w / count(*) OVER w, 2), 0)), 0) END AS z FROM rf
   WINDOW w AS (PARTITION BY surface, band {DAY}))"""


def paced(s: SparkSession, d: str) -> DataFrame:
    found = pace.sectionals(race_laps(s, d), "laps").select("race_id", "pace")
    return pace.by_condition(runs(s, d).join(found, "race_id", "left"), "pace", "z")


@query("pace_by_condition", f"WITH {PACE_SQL} SELECT race_id, post_no, round(z, 5) AS z FROM runs LEFT JOIN rz USING (race_id)")
def _pace_z(s: SparkSession, d: str) -> DataFrame:
    return out(paced(s, d), "z", digits=5)


@query("pace_features", f"""WITH {PACE_SQL}, x AS (SELECT runs.*, z FROM runs LEFT JOIN rz USING (race_id)),
 y AS (SELECT *, lag(z) OVER ({H} ORDER BY day, race_id, post_no) AS pv, avg(z) OVER r AS m, avg(z) FILTER (finish_rank <= 3) OVER r AS p,
  CASE WHEN count(*) FILTER (round(z, 9) > 0) OVER r >= 2 THEN avg(CASE WHEN finish_rank <= 3 THEN 1 ELSE 0 END) FILTER (round(z, 9) > 0) OVER r END AS f, CASE WHEN count(*) FILTER (round(z, 9) <= 0) OVER r >= 2 THEN avg(CASE WHEN finish_rank <= 3 THEN 1 ELSE 0 END) FILTER (round(z, 9) <= 0) OVER r END AS l
  FROM x WINDOW r AS ({H} {ROW}))
 SELECT race_id, post_no, round(pv, 5) AS pace_previous, round(m, 5) AS pace_mean, round(p, 5) AS pace_placed, round(f, 5) AS fast_show, round(l, 5) AS slow_show, round(f - l, 5) + 0 AS fast_less_slow FROM y""")  # fmt: skip
def _pace_features(s: SparkSession, d: str) -> DataFrame:
    found = pace.pace_features(paced(s, d), "z").withColumn("fast_less_slow", F.round("fast_less_slow", 5) + 0.0)
    return out(found, "pace_previous", "pace_mean", "pace_placed", "fast_show", "slow_show", "fast_less_slow", digits=5)


@query("expected_pace", f"""WITH {SCENE_SQL}, v AS (SELECT race_id, day, min_by(round(coalesce(pressure, -1) * 20), post_no) AS bin, min_by(sqrt(price), post_no) AS v FROM scene GROUP BY 1, 2),
 e AS (SELECT race_id, CASE WHEN count(v) OVER w >= 50 THEN avg(v) OVER w END AS e FROM v WINDOW w AS (PARTITION BY bin {DAY})) SELECT race_id, post_no, round(e, 4) AS expected_pace FROM runs JOIN e USING (race_id)""")  # fmt: skip
def _expected(s: SparkSession, d: str) -> DataFrame:
    found = pace.expected_pace(style.pace_scenario(style.running_style(positions(s, d), "pos")).withColumn("v", F.sqrt("price")), "pressure", "v")
    return out(found, "expected_pace", digits=4)


@query("level_features", f"""WITH {POS_SQL}, l AS (SELECT *, 6 - CAST(substr(grade, 1, 1) AS BIGINT) AS level, row_number() OVER ({H} ORDER BY day, race_id, post_no) AS rn FROM pos),
 f AS (SELECT *, lag(level) OVER o AS lp, avg(level) OVER w AS l5, max(level) OVER r AS hi, CASE WHEN count(rel) OVER w >= 3 THEN regr_slope(rel, CASE WHEN rel IS NOT NULL THEN rn END) OVER w END AS sl, avg(rel) OVER ({H} {LAST.format(n=3)}) - avg(rel) OVER r AS rc
  FROM l WINDOW o AS ({H} ORDER BY day, race_id, post_no), w AS ({H} {LAST.format(n=5)}), r AS ({H} {ROW}))
 SELECT race_id, post_no, lp AS level_previous, {settle_sql('l5')} AS level_last5, hi AS level_highest, level - lp AS level_change, level - hi AS level_below, {settle_sql('sl')} + 0 AS rank_slope, {settle_sql('rc')} + 0 AS rank_recent FROM f""")  # fmt: skip
def _levels(s: SparkSession, d: str) -> DataFrame:
    found = levels.level_features(positions(s, d).withColumn("level", 6 - F.substring("grade", 1, 1).cast("long")), "level", "rel")
    found = found.withColumns({c: settle(F.col(c)) for c in ("rank_slope", "rank_recent")})
    return out(found, "level_previous", "level_last5", "level_highest", "level_change", "level_below", "rank_slope", "rank_recent", settled=("level_last5",))


@query("time_index", f"""WITH {RUNS}, z AS (SELECT *, CASE WHEN count(*) OVER c >= 30 THEN least(greatest((avg(price) OVER c - price) / nullif(stddev_pop(price) OVER c, 0), -1.5), 1.5) END AS z FROM runs WINDOW c AS (PARTITION BY surface, going {DAY}))
 SELECT race_id, post_no, round(lag(z) OVER ({H} ORDER BY day, race_id, post_no), 5) AS time_previous, round(avg(z) OVER ({H} {LAST.format(n=5)}), 5) AS time_last5, round(max(z) OVER ({H} {ROW}), 5) AS time_best FROM z""")  # fmt: skip
def _time(s: SparkSession, d: str) -> DataFrame:
    return out(levels.time_index(runs(s, d), ["surface", "going"], F.col("price"), limit=1.5), "time_previous", "time_last5", "time_best", digits=5)


@query("past_least_day", f"WITH {RUNS} SELECT race_id, post_no, round(min(price) OVER ({H} {DAY}), 4) AS x FROM runs")
def _least(s: SparkSession, d: str) -> DataFrame:
    return out(levels.past_extreme(runs(s, d), ["horse_id"], F.col("price"), "x", False, "day"), "x", digits=4)


@query("substituted_value", f"""WITH {RUNS}, p AS (SELECT *, last_value(CASE WHEN distance > 1000 THEN distance END IGNORE NULLS) OVER ({H} {ROW}) AS before FROM runs)
 SELECT race_id, post_no, CASE WHEN venue % 3 = 0 THEN before ELSE distance END AS value, CAST(CASE WHEN venue % 3 = 0 THEN 0 ELSE distance - before END AS BIGINT) AS change, CASE WHEN venue % 3 <> 0 THEN 'own' WHEN before IS NOT NULL THEN 'previous' ELSE 'none' END AS origin FROM p""")  # fmt: skip
def _substituted(s: SparkSession, d: str) -> DataFrame:
    found = past.substituted(runs(s, d), ["horse_id"], "distance", F.col("distance") > 1000, F.col("venue") % 3 == 0)
    return out(found, "value", "change", "origin")
