"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import codes
from furlong.operators import bets, market, reports
from furlong.plans.base import out, query
from furlong.plans.models import HIT, _bound, hit
from furlong.plans.registry import CARDS, HARVILLE, RACE_SQL, priced, ranked
from furlong.sources.views import RUNS, cards, runs, table

GRADED = ["1-URGENT", "2-HIGH"]
RACES_SQL = f"{RUNS}, races AS (SELECT race_id, min(race_date) AS race_date, CAST(min(year(race_date)) AS BIGINT) AS year, min(grade) AS grade, min(payout) AS payout, min(distance) AS distance, count(*) AS field FROM runs GROUP BY 1)"


def races(s: SparkSession, d: str) -> DataFrame:
    return runs(s, d).groupBy("race_id").agg(F.min("race_date").alias("race_date"), F.year(F.min("race_date")).cast("long").alias("year"), F.min("grade").alias("grade"), F.min("payout").alias("payout"), F.min("distance").alias("distance"), F.count("*").alias("field"))


@query("null_shares", f"""WITH {RACES_SQL}, a AS (SELECT CAST(year(race_date) AS BIGINT) AS year, count(*) AS runners, round(avg(CASE WHEN horse_id % 5 = 0 THEN 1 ELSE 0 END), 6) AS no_style FROM runs WHERE year(race_date) > 1992 GROUP BY 1),
 b AS (SELECT year, count(*) AS races, round(avg(CASE WHEN field < 3 THEN 1 ELSE 0 END), 6) AS no_trio FROM races WHERE year < 1998 GROUP BY 1) SELECT coalesce(a.year, b.year) AS year, runners, no_style, races, no_trio FROM a FULL JOIN b ON a.year = b.year""")  # fmt: skip
def _nulls(s: SparkSession, d: str) -> DataFrame:
    a = runs(s, d).withColumns({"year": F.year("race_date").cast("long"), "style": F.when(F.col("horse_id") % 5 != 0, 1)}).where("year > 1992")
    b = races(s, d).where("year < 1998").withColumn("trio", F.when(F.col("field") >= 3, 1))
    return out(reports.null_shares(a, b, "year", ["style"], ["trio"]), "runners", "no_style", "races", "no_trio", keys=["year"])


@query("kind_coverage", f"""WITH {RACES_SQL}, k AS (SELECT year, unnest([{{'kind': 'win', 'has': field >= 1}}, {{'kind': 'exacta', 'has': field >= 2}}, {{'kind': 'trio', 'has': field >= 3}}]) AS u FROM races) SELECT year, u.kind AS kind, count(*) AS races, round(avg(CASE WHEN u.has THEN 1 ELSE 0 END), 6) AS share FROM k GROUP BY 1, 2""")
def _kinds(s: SparkSession, d: str) -> DataFrame:
    k = races(s, d).select("year", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), (F.col("field") >= m).alias("has")) for m, n in ((1, "win"), (2, "exacta"), (3, "trio"))))).alias("u"))
    return out(k.groupBy("year", "u.kind").agg(F.count("*").alias("races"), F.avg(F.col("u.has").cast("int")).alias("share")), "races", "share", keys=["year", "kind"])


@query("payout_trend", f"""WITH {RACES_SQL}, l AS (SELECT year, payout, unnest(list_concat(['all', CASE WHEN grade IN ('1-URGENT', '2-HIGH') THEN 'graded' ELSE 'flat' END], CASE WHEN grade = '1-URGENT' THEN ['top'] ELSE [] END)) AS g FROM races)
 SELECT year, {', '.join(f"nullif(count(*) FILTER (g = '{g}'), 0) AS {g}_n, round(quantile_cont(payout, 0.5) FILTER (g = '{g}'), 4) AS {g}_median, round(avg(CASE WHEN payout >= 150000 THEN 1 ELSE 0 END) FILTER (g = '{g}'), 6) AS {g}_share" for g in ('all', 'graded', 'flat', 'top'))} FROM l GROUP BY 1""")  # fmt: skip
def _trend(s: SparkSession, d: str) -> DataFrame:
    found = reports.trend(races(s, d), "year", reports.segment_labels(F.col("grade"), GRADED, "1-URGENT"), "payout", 150_000, ["all", "graded", "flat", "top"])
    cols = [f"{g}_{m}" for g in ("all", "graded", "flat", "top") for m in ("n", "median", "share")]
    return out(found.withColumns({c: F.round(c, 4) for c in cols if c.endswith("median")}), *cols, keys=["year"])


@query("sectional_agreement", f"""WITH {RUNS}, b AS (SELECT distance, win_odds AS a, CASE WHEN horse_id % 4 = 0 THEN NULL ELSE win_odds + (horse_id % 9) / 100 - 0.035 END AS b FROM runs WHERE distance <= 1500)
 SELECT distance, count(*) AS n, round(avg(CASE WHEN abs(a - b) < 0.03 THEN 1 ELSE 0 END), 6) AS same, round(avg(a - b), 6) AS mean_gap, round(avg(abs(a - b)), 6) AS mean_abs_gap FROM b WHERE b IS NOT NULL GROUP BY ROLLUP (distance)""")  # fmt: skip
def _agreement(s: SparkSession, d: str) -> DataFrame:
    b = runs(s, d).where("distance <= 1500").withColumn("b", F.when(F.col("horse_id") % 4 != 0, F.col("win_odds") + (F.col("horse_id") % 9) / 100 - 0.035))
    return out(reports.agreement(b, "distance", "win_odds", "b", 0.03), "n", "same", "mean_gap", "mean_abs_gap", keys=["distance"])


@query("zero_reasons", f"""WITH {RUNS}, z AS (SELECT CAST(year(race_date) AS BIGINT) AS year, CASE WHEN horse_id % 6 = 0 THEN 0 ELSE 1 END AS v, CASE WHEN horse_id % 12 = 0 THEN 'scratched' WHEN horse_id % 6 = 0 THEN 'unknown' END AS why FROM runs)
 SELECT year, round(avg(CASE WHEN v = 0 THEN 1 ELSE 0 END), 6) AS zero_share, count(*) FILTER (why = 'scratched') AS scratched, count(*) FILTER (why = 'unknown') AS unknown FROM z GROUP BY 1""")  # fmt: skip
def _zeros(s: SparkSession, d: str) -> DataFrame:
    why = F.when(F.col("horse_id") % 12 == 0, "scratched").when(F.col("horse_id") % 6 == 0, "unknown")
    z = runs(s, d).select(F.year("race_date").cast("long").alias("year"), F.when(F.col("horse_id") % 6 == 0, 0).otherwise(1).alias("v"), why.alias("why"))
    wide = z.groupBy("year").pivot("why", ["scratched", "unknown"]).agg(F.count(F.lit(1)))
    shares = z.groupBy("year").agg(F.avg((F.col("v") == 0).cast("int")).alias("zero_share"))
    return out(shares.join(wide, "year").fillna(0, ["scratched", "unknown"]), "zero_share", "scratched", "unknown", keys=["year"])


@query("hot_payouts", f"""WITH {RACE_SQL}, h AS (SELECT grade, payout FROM t WHERE {HIT.format(a=2, b=3, c=4)} = 1), l AS (SELECT unnest([grade, 'all']) AS grade, payout FROM h)
 SELECT grade, count(*) AS n, {', '.join(f'round(quantile_cont(payout, {q}), 4) AS {n}' for q, n in ((0.0, 'low'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1.0, 'high')))} FROM l GROUP BY 1""")  # fmt: skip
def _hot(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).where(hit(2, 3, 4) == 1)
    return reports.five_numbers(t, "grade", "payout").select("grade", "n", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


@query("box_hits", f"WITH {RACE_SQL} SELECT race_id, CAST({HIT.format(a=4, b=4, c=4)} AS BIGINT) AS hit, CAST(CASE WHEN {HIT.format(a=4, b=4, c=4)} = 1 AND payout >= 150000 THEN 1 ELSE 0 END AS BIGINT) AS hot FROM t")
def _box(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).withColumn("hit", hit(4, 4, 4))
    return out(t.withColumn("hot", ((F.col("hit") == 1) & (F.col("payout") >= 150_000)).cast("int")), "hit", "hot", keys=["race_id"])


@query("plan_rates", f"""WITH {RACE_SQL}, g AS (SELECT grade, field >= 5 AS large, count(*) AS n, sum({HIT.format(a=2, b=3, c=4)}) AS h, count(*) * 1200 AS stake, sum(CASE WHEN {HIT.format(a=2, b=3, c=4)} = 1 THEN payout / 50 ELSE 0 END) AS paid, avg(1 / field) AS predicted FROM t GROUP BY 1, 2)
 SELECT grade, large, n, CAST(h AS BIGINT) AS hits, CAST(stake AS BIGINT) AS stake, round(paid, 4) AS paid, round(h / n, 6) AS rate, round({_bound('h', 'n', False)}, 6) AS low, round({_bound('h', 'n', True)}, 6) AS high, round(paid / stake, 5) AS roi, round(h / n - predicted, 6) AS above FROM g""")  # fmt: skip
def _rates(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).withColumns({"hit": hit(2, 3, 4), "large": F.col("field") >= 5})
    g = reports.rates(t, ["grade", "large"], F.col("hit"), F.lit(1200), F.when(F.col("hit") == 1, F.col("payout") / 50).otherwise(0.0), 1 / F.col("field"))
    return out(g.withColumns({"paid": F.round("paid", 4), "roi": F.round("roi", 5)}), "n", "hits", "stake", "paid", "rate", "low", "high", "roi", "above", keys=["grade", "large"])


@query("payout_check", f"""WITH {HARVILLE}, w AS (SELECT race_id, max(CASE WHEN finish_rank = 1 THEN post_no END) AS a, max(CASE WHEN finish_rank = 2 THEN post_no END) AS b FROM cards GROUP BY 1),
 q AS (SELECT race_id, 'exacta' AS kind, i AS x, j AS y, 75 / sum(prob) AS est FROM tensor GROUP BY ALL UNION ALL SELECT race_id, 'quinella', least(i, j), greatest(i, j), 77.5 / sum(prob) FROM tensor GROUP BY ALL),
 c AS (SELECT kind, q.race_id, est, est * (0.553 + q.race_id % 11 / 10) AS paid FROM q JOIN w ON q.race_id = w.race_id AND x = CASE WHEN kind = 'exacta' THEN a ELSE least(a, b) END AND y = CASE WHEN kind = 'exacta' THEN b ELSE greatest(a, b) END),
 l AS (SELECT *, ln(paid / est) AS r FROM c)
 SELECT kind, count(*) AS n, round(exp(quantile_cont(r, 0.5)), 5) AS median, round(quantile_cont(r, 0.25), 5) AS q1, round(quantile_cont(r, 0.75), 5) AS q3, round(avg(CASE WHEN abs(exp(r) - 1) <= 0.25 THEN 1 ELSE 0 END), 6) AS within25,
 round(avg(CASE WHEN abs(exp(r) - 1) <= 0.5 THEN 1 ELSE 0 END), 6) AS within50, round(corr(ln(paid), ln(est)), 5) AS correlation FROM l GROUP BY 1""")  # fmt: skip
def _payouts(s: SparkSession, d: str) -> DataFrame:
    races = market.winners(priced(s, d), first=1, second=2)
    own = {"exacta": (F.col("first"), F.col("second")), "quinella": (F.least("first", "second"), F.greatest("first", "second"))}
    both = [market.pairs(races, k).where((F.col("a") == x) & (F.col("b") == y)).select("race_id", F.lit(k).alias("kind"), codes.estimated_payout(F.col("prob"), k).alias("est")) for k, (x, y) in own.items()]
    c = both[0].unionByName(both[1])
    c = c.withColumn("paid", F.col("est") * (0.553 + F.col("race_id") % 11 / 10)).withColumn("r", F.log(F.col("paid") / F.col("est")))
    q = reports.quantiles(c, ["kind"], "r", [0.25, 0.5, 0.75])
    within = lambda x: F.avg((F.abs(F.exp("r") - 1) <= x).cast("int"))
    rest = c.groupBy("kind").agg(within(0.25).alias("within25"), within(0.5).alias("within50"), F.corr(F.log("paid"), F.log("est")).alias("correlation"))
    return q.join(rest, "kind").select("kind", "n", F.round(F.exp(F.col("q")[1]), 5).alias("median"), F.round(F.col("q")[0], 5).alias("q1"), F.round(F.col("q")[2], 5).alias("q3"), F.round("within25", 6).alias("within25"), F.round("within50", 6).alias("within50"), F.round("correlation", 5).alias("correlation"))


# Early and final odds of runners, as pairs.
DRIFT_SQL = f"""{CARDS}, dr AS (SELECT race_id, post_no, surface, win_odds AS early, win_odds * (0.7 + (horse_id % 13) / 20) AS final, CAST(100 * (horse_id % 40 + 1) AS BIGINT) AS stake, win_odds * (0.8 + (horse_id % 7) / 15) AS late, CASE WHEN win_odds >= 10 THEN 2 WHEN win_odds >= 4 THEN 1 ELSE 0 END AS band FROM cards),
 pr AS (SELECT *, final / early AS ratio, ln(final / early) AS lr, ln(final / late) AS lr2, final * stake >= 10000 - 1e-6 AS reaches FROM dr)"""


def _drift(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = cards(s, d).select("race_id", "post_no", "surface", "win_odds", (100 * (F.col("horse_id") % 40 + 1)).cast("long").alias("stake"), (0.7 + (F.col("horse_id") % 13) / 20).alias("f"), (0.8 + (F.col("horse_id") % 7) / 15).alias("l"))
    c = c.withColumn("band", bets.band(F.col("win_odds"), [4, 10]))
    odds = lambda x: c.select("race_id", "post_no", "surface", "band", "stake", x.alias("odds"))
    return odds(F.col("win_odds")), odds(F.col("win_odds") * F.col("f")), odds(F.col("win_odds") * F.col("l"))


def _pairs(early: DataFrame, final: DataFrame) -> DataFrame:
    keys = ["race_id", "post_no", "surface", "band"]
    return reports.drift_pairs(early, final, keys, 10_000, "stake")


@query("drift_pairs", f"WITH {DRIFT_SQL} SELECT race_id, post_no, round(ratio, 6) AS ratio, round(lr, 6) AS log_ratio, reaches FROM pr")
def _drift_pairs(s: SparkSession, d: str) -> DataFrame:
    early, final, _ = _drift(s, d)
    return out(_pairs(early, final), "ratio", "log_ratio", "reaches")


@query("drift_table", f"""WITH {DRIFT_SQL}, l AS (SELECT *, unnest(list_concat(['all', CASE WHEN surface IN ('click', 'view') THEN 'graded' ELSE 'flat' END], CASE WHEN surface = 'click' THEN ['top'] ELSE [] END)) AS segment FROM pr)
 SELECT segment, CAST(band AS BIGINT) AS band, count(*) AS n, {', '.join(f'round(quantile_cont(ratio, {q}), 6) AS {n}' for q, n in ((0.25, 'q1'), (0.5, 'median'), (0.75, 'q3')))}, round(avg(lr), 6) AS mean_log, round(stddev_samp(lr), 6) AS std_log, round(avg(CASE WHEN reaches THEN 1 ELSE 0 END), 6) AS reach_share, count(DISTINCT race_id) AS races FROM l GROUP BY 1, 2""")  # fmt: skip
def _drift_table(s: SparkSession, d: str) -> DataFrame:
    early, final, _ = _drift(s, d)
    p = _pairs(early, final).withColumn("segment", F.explode(reports.segment_labels(F.col("surface"), ["click", "view"], "click")))
    t = reports.drift_table(p, ["segment", "band"])
    return out(t.withColumns({n: F.col("q")[i] for i, n in enumerate(("q1", "median", "q3"))}), "n", "q1", "median", "q3", "mean_log", "std_log", "reach_share", "races", keys=["segment", "band"])


@query("drift_compare", f"WITH {DRIFT_SQL}, l AS (SELECT *, unnest([CAST(band AS VARCHAR), 'all']) AS b FROM pr) SELECT surface, b AS band, count(*) AS n, round(avg(abs(lr)), 6) AS early_move, round(avg(abs(lr2)), 6) AS late_move, round(avg(CASE WHEN abs(lr2) < abs(lr) THEN 1 ELSE 0 END), 6) AS calmer FROM l GROUP BY 1, 2")
def _drift_compare(s: SparkSession, d: str) -> DataFrame:
    early, final, late = _drift(s, d)
    return out(reports.drift_compare(_pairs(early, final), _pairs(late, final), ["race_id", "post_no"], ["surface", "band"], "band"), "n", "early_move", "late_move", "calmer", keys=["surface", "band"])


@query("snapshot_drift", f"""WITH {DRIFT_SQL}, s AS (SELECT race_id, post_no, u.m AS minutes, early * (1 + (u.m % 7) / 40) AS odds, final FROM pr, (SELECT unnest([10, 20, 60]) AS m) u)
 SELECT race_id, CAST(minutes AS BIGINT) AS minutes, count(*) AS n, round(avg(abs(ln(odds / final))), 6) AS move, round(avg(CASE WHEN abs(odds / final - 1) <= 0.10 THEN 1 ELSE 0 END), 6) AS within10, round(avg(CASE WHEN abs(odds / final - 1) <= 0.25 THEN 1 ELSE 0 END), 6) AS within25 FROM s GROUP BY 1, 2""")  # fmt: skip
def _snapshots(s: SparkSession, d: str) -> DataFrame:
    early, final, _ = _drift(s, d)
    snaps = early.withColumn("minutes", F.explode(F.array(F.lit(10), F.lit(20), F.lit(60)))).withColumn("odds", F.col("odds") * (1 + (F.col("minutes") % 7) / 40))
    return out(reports.snapshot_drift(snaps, final, ["race_id", "post_no"]), "minutes", "n", "move", "within10", "within25", keys=["race_id"])


@query("races_due", f"WITH {CARDS}, r AS (SELECT race_id, hour(min(start_ts)) * 60 + minute(min(start_ts)) - 600 AS m FROM cards GROUP BY 1) SELECT race_id, CAST(m AS BIGINT) AS minutes FROM r WHERE m BETWEEN 15 AND 125 AND race_id % 3 <> 1")
def _due(s: SparkSession, d: str) -> DataFrame:
    r = cards(s, d).groupBy("race_id").agg(F.min("start_ts").alias("t")).withColumn("minutes", (F.hour("t") * 60 + F.minute("t") - 600).cast("long"))
    return reports.due(r, r.where("race_id % 3 = 1"), "minutes", 15, 125).select("race_id", "minutes")


@query("feature_importance", "WITH l AS (SELECT 'f' || l_linenumber AS feature, l_quantity AS gain FROM lineitem), g AS (SELECT feature, sum(gain) AS gain FROM l GROUP BY 1) SELECT feature, round(gain, 4) AS gain, rank() OVER (ORDER BY gain DESC) AS rank, round(gain / sum(gain) OVER (), 6) AS share FROM g")
def _importance(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), F.col("l_quantity").alias("gain"))
    return out(reports.importance(g, "gain"), "gain", "rank", "share", keys=["feature"])


@query("quintile_rates", f"""WITH {RUNS}, e AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS e FROM runs) SELECT CAST(len([x for x in e if price > x]) + 1 AS BIGINT) AS part, count(*) AS n, round(avg(CASE WHEN finish_rank IN (2, 3) THEN 1 ELSE 0 END), 6) AS placed FROM runs, e GROUP BY 1""")
def _quintiles(s: SparkSession, d: str) -> DataFrame:
    p = reports.equal_parts(runs(s, d), "price", 5, "part")
    return out(p.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.col("finish_rank").isin(2, 3).cast("int")).alias("placed")), "n", "placed", keys=["part"])


@query("fold_rates", f"WITH {RACE_SQL}, x AS (SELECT unnest(['fold ' || CAST(race_id % 4 AS VARCHAR), 'pooled']) AS fold, CASE WHEN grade IN ('1-URGENT', '2-HIGH') THEN 'graded' ELSE 'flat' END AS segment, {HIT.format(a=2, b=3, c=4)} AS h FROM t) SELECT fold, segment, count(*) AS n, CAST(sum(h) AS BIGINT) AS hits, round(avg(h), 6) AS rate FROM x GROUP BY 1, 2")
def _folds(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).withColumn("fold", F.explode(F.array(F.concat(F.lit("fold "), (F.col("race_id") % 4).cast("string")), F.lit("pooled"))))
    g = t.groupBy("fold", F.when(F.col("grade").isin(*GRADED), "graded").otherwise("flat").alias("segment")).agg(F.count("*").alias("n"), F.sum(hit(2, 3, 4)).alias("hits"), F.avg(hit(2, 3, 4)).alias("rate"))
    return out(g, "n", "hits", "rate", keys=["fold", "segment"])


@query("segments_side_by_side", f"""WITH {RACE_SQL}, u AS (SELECT *, unnest([1, 2, 3]) AS k FROM t), s AS (SELECT k, grade IN ('1-URGENT', '2-HIGH') AS g, CASE WHEN r1 <= k AND r2 <= k + 1 AND r3 <= k + 2 THEN 1 ELSE 0 END AS h FROM u),
 c AS (SELECT CAST(k AS BIGINT) AS n1, count(*) FILTER (g) AS na, sum(h) FILTER (g) AS ha, count(*) FILTER (NOT g) AS nb, sum(h) FILTER (NOT g) AS hb FROM s GROUP BY 1)
 SELECT n1, na AS n_graded, round(ha / na, 6) AS rate_graded, nb AS n_flat, round(hb / nb, 6) AS rate_flat, {_bound('ha', 'na', False)} > {_bound('hb', 'nb', True)} OR {_bound('hb', 'nb', False)} > {_bound('ha', 'na', True)} AS apart FROM c""")  # fmt: skip
def _side(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("n1"), hit(k, k + 1, k + 2).alias("h")) for k in (1, 2, 3)))))
    g = t.groupBy("x.n1", F.when(F.col("grade").isin(*GRADED), "graded").otherwise("flat").alias("segment")).agg(F.count("*").alias("n"), F.sum("x.h").alias("hits"))
    low, high = reports.wilson(F.col("hits"), F.col("n"))
    g = g.withColumns({"rate": F.col("hits") / F.col("n"), "low": low, "high": high})
    side = lambda k: g.where(F.col("segment") == k).select("n1", *(F.col(c).alias(f"{c}_{k}") for c in ("n", "rate", "low", "high")))
    both = side("graded").join(side("flat"), "n1")
    return out(both.withColumn("apart", (F.col("low_graded") > F.col("high_flat")) | (F.col("low_flat") > F.col("high_graded"))), "n_graded", "rate_graded", "n_flat", "rate_flat", "apart", keys=["n1"])
