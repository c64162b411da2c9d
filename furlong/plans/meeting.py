"""Queries of meetings, biases and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import market, meeting
from furlong.plans.base import out, query
from furlong.plans.form import DAY, POS_SQL, positions
from furlong.plans.registry import DISCOUNTED, GAMMA, DELTA, P_SQL, priced
from furlong.sources.views import RUNS, runs

BIAS = f"""{POS_SQL}, rb AS (SELECT race_id, avg(post_no) - avg(post_no) FILTER (finish_rank <= 3) AS post_bias, avg(pos) - avg(pos) FILTER (finish_rank <= 3) AS position_bias, avg(sqrt(price)) AS v, min_by(day, post_no) AS day, min_by(venue, post_no) AS venue, min_by(surface, post_no) AS surface, min_by(grade, post_no) AS grade FROM pos GROUP BY 1)"""


def race_bias(s: SparkSession, d: str) -> DataFrame:
    # so few races share a venue and distance here that the distance is left at one value
    p = positions(s, d).withColumns({"v": F.sqrt("price"), "distance": F.lit(1)})
    return meeting.race_bias(p, "pos", "v", 10)


@query("race_bias", f"""WITH {BIAS} SELECT race_id, round(post_bias, 6) + 0 AS post_bias, round(position_bias, 6) + 0 AS position_bias,
 CASE WHEN count(*) OVER w >= 10 THEN round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 5) END AS closing FROM rb WINDOW w AS (PARTITION BY venue, surface {DAY})""")  # fmt: skip
def _race_bias(s: SparkSession, d: str) -> DataFrame:
    b = race_bias(s, d).withColumns({c: F.round(c, 6) + 0.0 for c in ("post_bias", "position_bias")}).withColumn("closing", F.round("closing", 5))
    return out(b, "post_bias", "position_bias", "closing", keys=["race_id"])


MEETING = f"""{BIAS}, mb AS (SELECT race_id, sum(position_bias) OVER w AS s, count(position_bias) OVER w AS n FROM rb WINDOW w AS (PARTITION BY venue, surface {DAY})), mt AS (SELECT race_id, coalesce(s, 0) / (n + 2) AS meeting_bias, n AS meeting_races FROM mb)"""


@query("meeting_bias", f"WITH {MEETING} SELECT race_id, round(meeting_bias, 6) + 0 AS meeting_bias, meeting_races FROM mt")
def _meeting(s: SparkSession, d: str) -> DataFrame:
    m = meeting.meeting_bias(race_bias(s, d), ["venue", "surface"], "position_bias")
    return out(m.withColumn("meeting_bias", F.round("meeting_bias", 6) + 0.0), "meeting_bias", "meeting_races", keys=["race_id"])


@query("bias_terms", f"""WITH {MEETING} SELECT race_id, post_no, round(coalesce(meeting_bias * CASE WHEN max(post_no) OVER (PARTITION BY race_id) > 1 THEN (post_no - 1) / (max(post_no) OVER (PARTITION BY race_id) - 1) END, 0), 6) + 0 AS bias_post, round(coalesce(meeting_bias * pos, 0), 6) + 0 AS bias_style FROM pos JOIN mt USING (race_id)""")
def _terms(s: SparkSession, d: str) -> DataFrame:
    m = meeting.meeting_bias(race_bias(s, d), ["venue", "surface"], "position_bias").select("race_id", "meeting_bias")
    t = meeting.bias_terms(positions(s, d).join(m, "race_id"), F.col("meeting_bias"), F.col("pos"))
    return out(t.withColumns({c: F.round(c, 6) + 0.0 for c in ("bias_post", "bias_style")}), "bias_post", "bias_style")


@query("place_residual", f"""WITH {DISCOUNTED}, e AS (SELECT race_id, j AS post_no, prob FROM tensor UNION ALL SELECT race_id, k, prob FROM tensor), x AS (SELECT race_id, post_no, sum(prob) AS p FROM e GROUP BY 1, 2),
 c AS (SELECT m.race_id, m.post_no, horse_id, date_diff('day', DATE '1970-01-01', CAST(start_ts AS DATE)) AS day, CASE WHEN finish_rank IN (2, 3) THEN 1 ELSE 0 END - x.p AS gap FROM m JOIN x USING (race_id, post_no)),
 t AS (SELECT horse_id, day, sum(gap) AS s, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT horse_id, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM t WINDOW w AS (PARTITION BY horse_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT race_id, post_no, round(coalesce(s, 0) / (coalesce(n, 0) + 2), 6) + 0 AS place_residual FROM c LEFT JOIN b USING (horse_id, day)""")  # fmt: skip
def _residual(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d)
    p = market.marginals(market.finish_tensor(m, "p", GAMMA, DELTA)).select("race_id", "post_no", (F.col("p2") + F.col("p3")).alias("e"))
    c = m.join(p, ["race_id", "post_no"]).withColumn("day", F.datediff(F.col("start_ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    return out(meeting.place_residual(c, "e").withColumn("place_residual", F.round("place_residual", 6) + 0.0), "place_residual")


@query("scored_runners", f"""WITH {RUNS}, q AS (SELECT race_id, post_no, sqrt(price) AS q FROM runs) SELECT race_id, post_no, round(q / sum(q) OVER (PARTITION BY race_id), 6) AS probability, row_number() OVER (PARTITION BY race_id ORDER BY round(q, 12) DESC, post_no) AS predicted_rank FROM q""")
def _scored(s: SparkSession, d: str) -> DataFrame:
    return out(meeting.scored(runs(s, d).withColumn("q", F.sqrt("price")), "q"), "probability", "predicted_rank")


@query("race_lines", f"""WITH {P_SQL}, k AS (SELECT race_id, post_no, row_number() OVER (PARTITION BY race_id ORDER BY round(p, 12) DESC, post_no) AS r FROM m) SELECT race_id, string_agg(CAST(post_no AS VARCHAR), '・' ORDER BY r) AS line FROM k WHERE r <= 6 GROUP BY 1""")
def _lines(s: SparkSession, d: str) -> DataFrame:
    return meeting.race_lines(meeting.scored(priced(s, d), "p"), "predicted_rank", 6)


@query("target_features", f"""WITH {RUNS}, h AS (SELECT * FROM runs WHERE day % 9 > 0), t AS (SELECT * FROM runs WHERE day % 9 = 0) SELECT t.race_id, t.post_no, round(avg(h.finish_rank), 6) AS mean_rank FROM t LEFT JOIN h ON h.horse_id = t.horse_id AND h.day < t.day GROUP BY 1, 2""")
def _targets(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    found = meeting.one_day_features(r.where("day % 9 > 0"), r.where("day % 9 = 0").select("race_id", "post_no", "horse_id", "day"), ["horse_id"], F.col("finish_rank"), "mean_rank")
    return out(found, "mean_rank")


@query("rank_names", f"""WITH {RUNS} SELECT race_id, string_agg(horse_id || '', '-' ORDER BY finish_rank) FILTER (finish_rank <= 3) AS first_three FROM runs WHERE contains(grade, 'URGENT') GROUP BY 1""")
def _names(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d).where(F.col("grade").contains("URGENT") & (F.col("finish_rank") <= 3))
    three = F.array_sort(F.collect_list(F.struct("finish_rank", F.col("horse_id").cast("string").alias("h"))))  # three of a race
    return r.groupBy("race_id").agg(F.array_join(F.transform(three, lambda x: x["h"]), "-").alias("first_three"))
