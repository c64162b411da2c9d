"""Queries of bets, their settlement, and the choice of races."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.operators import betting, bets, market
from furlong.plans.base import out, query
from furlong.plans.models import HIT, _bound, hit
from furlong.plans.registry import DIFFICULTY_SQL, HARVILLE, MODEL_SQL, P_SQL, RACE_SQL, priced, ranked
from furlong.sources.views import CARDS, RUNS, cards, runs

TOP = "row_number() OVER (PARTITION BY race_id ORDER BY round(p, 12) DESC, post_no)"


@query("ordered_box", f"WITH {P_SQL}, t AS (SELECT race_id, post_no FROM m QUALIFY {TOP} <= 4) SELECT a.race_id, a.post_no AS i, b.post_no AS j, c.post_no AS k FROM t a JOIN t b USING (race_id) JOIN t c USING (race_id) WHERE a.post_no <> b.post_no AND a.post_no <> c.post_no AND b.post_no <> c.post_no")
def _box(s: SparkSession, d: str) -> DataFrame:
    return betting.ordered_box(priced(s, d), "p", 4)


@query("hot_top", f"WITH {HARVILLE} SELECT race_id, i, j, k, round(72.5 / prob, 2) AS estimated, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 10) DESC, i, j, k) AS place FROM tensor WHERE 72.5 / prob >= 50000 QUALIFY place <= 12")
def _hot_top(s: SparkSession, d: str) -> DataFrame:
    t = betting.hot_contenders(market.strengths(priced(s, d)), 12, 50_000)
    return t.select("race_id", "i", "j", "k", F.round("estimated", 2).alias("estimated"), "place")


PLANS = [("box 4", "trifecta", 4, 4, 4), ("trio 5", "trio", 5, 5, 5), ("two axes 6", "trifecta", 2, 2, 6), ("formation 1-3-5", "trifecta", 1, 3, 5)]
PLANS_SQL = ", ".join(f"{{'s': '{n}', 't': {str(k == 'trio').lower()}, 'a': {a}, 'b': {b}, 'c': {c}}}" for n, k, a, b, c in PLANS)


@query("strategy_table", f"""WITH {RACE_SQL}, u AS (SELECT t.*, unnest([{PLANS_SQL}]) AS x FROM t), h AS (SELECT x.s AS strategy, r1 <= x.a AND r2 <= x.b AND r3 <= x.c AS hit, CASE WHEN x.t THEN least(x.a, field) * (least(x.a, field) - 1) * (least(x.a, field) - 2) / 6 ELSE least(x.a, field) * (least(x.b, field) - 1) * (least(x.c, field) - 2) END AS points, payout / CASE WHEN x.t THEN 6 ELSE 1 END AS pay FROM u),
 g AS (SELECT strategy, count(*) AS races, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND pay >= 60000) AS hot, CAST(sum(points) * 100 AS BIGINT) AS stake, sum(CASE WHEN hit THEN pay ELSE 0 END) AS paid FROM h GROUP BY 1) SELECT strategy, races, hits, hot, stake, round(paid, 2) AS paid, round(paid / stake, 5) AS roi FROM g""")  # fmt: skip
def _strategies(s: SparkSession, d: str) -> DataFrame:
    g = betting.strategies(bets.race_table(ranked(s, d)), PLANS, 60_000)
    return out(g.withColumns({"paid": F.round("paid", 2), "roi": F.round("roi", 5)}), "races", "hits", "hot", "stake", "paid", "roi", keys=["strategy"])


MIXED = "0.6 * p + 0.4 / count(*) OVER (PARTITION BY race_id)"


@query("gap_box", f"""WITH {MODEL_SQL}, q AS (SELECT race_id, post_no, finish_rank, win_odds, {MIXED} AS p FROM m), kk AS (SELECT *, {TOP} AS k1 FROM q), g AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY CASE WHEN k1 > 1 THEN round(p * win_odds, 12) END DESC NULLS LAST, post_no) AS g FROM kk)
 SELECT race_id, count(*) FILTER (finish_rank <= 3 AND (k1 = 1 OR g <= 2)) = 3 AND count(*) FILTER (finish_rank <= 3) = 3 AS hit FROM g GROUP BY 1""")  # fmt: skip
def _gap(s: SparkSession, d: str) -> DataFrame:
    m = market.market_probability(runs(s, d))
    return betting.gap_box(m.withColumn("p", 0.6 * F.col("p") + 0.4 / F.count("*").over(Window.partitionBy("race_id"))), "p", 2)


@query("value_sweep", f"""WITH {MODEL_SQL}, q AS (SELECT *, {MIXED} AS q FROM m), g AS (SELECT unnest([0.6, 0.9, 1.2]) AS t), f AS (SELECT unnest([1.0, 3.0, 5.0]) AS f)
 SELECT CAST(t AS DOUBLE) AS threshold, CAST(f AS DOUBLE) AS floor, count(*) AS bets, count(*) FILTER (finish_rank = 1) AS hits, round(sum(CASE WHEN finish_rank = 1 THEN win_odds ELSE 0 END) / count(*), 6) AS roi FROM q, g, f WHERE q * win_odds >= t AND win_odds >= f GROUP BY 1, 2""")  # fmt: skip
def _sweep(s: SparkSession, d: str) -> DataFrame:
    m = market.market_probability(runs(s, d)).withColumn("q", 0.6 * F.col("p") + 0.4 / F.count("*").over(Window.partitionBy("race_id")))
    return out(betting.value_sweep(m, "q", [0.6, 0.9, 1.2], [1.0, 3.0, 5.0]), "floor", "bets", "hits", "roi", keys=["threshold"])


@query("race_picks", f"""WITH {P_SQL}, q AS (SELECT *, {MIXED} AS q FROM m), e AS (SELECT *, q * win_odds AS ev FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(ev, 10) DESC, post_no) AS pick FROM e QUALIFY pick <= 8)
 SELECT race_id, post_no, round(ev, 6) AS ev, pick, CAST(floor(round(10000 / count(*) OVER (PARTITION BY race_id) / 100, 6)) * 100 AS BIGINT) AS flat,
 CAST(floor(round(10000 * coalesce(least(greatest((q * (win_odds - 1) - (1 - q)) / nullif(win_odds - 1, 0), 0), 0.2), 0) / 100, 6)) * 100 AS BIGINT) AS kelly FROM k""")  # fmt: skip
def _picks(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumn("q", 0.6 * F.col("p") + 0.4 / F.count("*").over(Window.partitionBy("race_id")))
    return out(betting.picks(m, "q", 8, 10_000.0, 0.2), "ev", "pick", "flat", "kelly")


@query("favorite_baseline", f"WITH {RUNS}, f AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY win_odds, post_no) <= 1) SELECT 'favorite' AS source, count(*) AS bets, count(*) FILTER (finish_rank = 1) AS hits, round(sum(CASE WHEN finish_rank = 1 THEN win_odds ELSE 0 END) / count(*), 6) AS roi FROM f")
def _favorite(s: SparkSession, d: str) -> DataFrame:
    return out(betting.baselines(runs(s, d), 1, 3).where("source = 'favorite'"), "bets", "hits", "roi", keys=["source"])


@query("random_baseline")
def _random(s: SparkSession, d: str) -> DataFrame:
    return out(betting.baselines(runs(s, d), 1, 3).where("source = 'random'"), "bets", "hits", "roi", keys=["source"])


SETTLE_SQL = f"""{P_SQL}, bt AS (SELECT a.race_id, a.post_no AS i, b.post_no AS j, u.kind, 100 * (a.post_no % 3 + 1) AS stake FROM m a JOIN m b ON a.race_id = b.race_id AND a.post_no <> b.post_no, (SELECT unnest(['exacta', 'quinella']) AS kind) u WHERE a.post_no <= 4 AND b.post_no <= 5),
 rs AS (SELECT race_id, max(CASE WHEN finish_rank = 1 THEN post_no END) AS a, max(CASE WHEN finish_rank = 2 THEN post_no END) AS b FROM m GROUP BY 1), sc AS (SELECT race_id, post_no FROM m WHERE horse_id % 29 = 0),
 st AS (SELECT bt.*, EXISTS (SELECT 1 FROM sc WHERE sc.race_id = bt.race_id AND sc.post_no IN (i, j)) AS gone, CASE WHEN kind = 'exacta' AND i = a AND j = b THEN 1500.0 WHEN kind = 'quinella' AND least(i, j) = least(a, b) AND greatest(i, j) = greatest(a, b) THEN 800.0 ELSE 0 END AS pay FROM bt JOIN rs USING (race_id))"""


@query("settlement", f"WITH {SETTLE_SQL} SELECT race_id, CAST(sum(stake) AS BIGINT) AS stake, round(sum(CASE WHEN gone THEN 0 ELSE pay * stake / 100 END), 4) AS paid, CAST(sum(CASE WHEN gone THEN stake ELSE 0 END) AS BIGINT) AS refund, sum(CASE WHEN gone THEN 0 ELSE pay END) > 0 AS hit, round(sum(CASE WHEN gone THEN stake ELSE pay * stake / 100 END) - sum(stake), 4) AS balance FROM st GROUP BY 1")
def _settle(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d)
    one, two = m.where("post_no <= 4").select("race_id", F.col("post_no").alias("i")), m.where("post_no <= 5").select("race_id", F.col("post_no").alias("j"))
    bt = one.join(two, "race_id").where("i <> j").select("race_id", F.explode(F.array(F.lit("exacta"), F.lit("quinella"))).alias("kind"), F.array("i", "j").alias("posts"), (100 * (F.col("i") % 3 + 1)).alias("stake"))
    at = lambda k: F.max(F.when(F.col("finish_rank") == k, F.lpad(F.col("post_no").cast("string"), 2, "0")))
    rows = m.groupBy("race_id").agg(F.concat(at(1), at(2)).alias("c")).withColumns({"x": F.lit("1500"), "q": F.lit("800")})
    wins = betting.winning(rows, "c", "x", "exacta", 2, True).unionByName(betting.winning(rows, "c", "q", "quinella", 2, False))
    return out(betting.settle(bt, wins, m.where("horse_id % 29 = 0").select("race_id", "post_no"), ["exacta"]), "stake", "paid", "refund", "hit", "balance", keys=["race_id"], digits=4)


@query("box_check", f"""WITH {MODEL_SQL}, g AS (SELECT race_id, count(*) FILTER (model_rank <= 6 AND horse_id % 13 > 0) AS runners, count(*) FILTER (model_rank <= 6 AND horse_id % 13 = 0) AS refunded, count(*) FILTER (finish_rank <= 3 AND model_rank <= 6 AND horse_id % 13 > 0) AS h, min(payout) AS pay FROM k GROUP BY 1),
 c AS (SELECT *, CASE WHEN runners >= 3 THEN runners * (runners - 1) * (runners - 2) * 100 ELSE 0 END AS stake FROM g) SELECT race_id, runners, refunded, CAST(stake AS BIGINT) AS stake, h = 3 AS hit, round(CASE WHEN h = 3 THEN pay ELSE 0 END, 4) AS paid, round(CASE WHEN h = 3 THEN pay ELSE 0 END - stake, 4) AS balance FROM c""")  # fmt: skip
def _box_check(s: SparkSession, d: str) -> DataFrame:
    return out(betting.box_check(ranked(s, d), 6, F.col("horse_id") % 13 == 0), "runners", "refunded", "stake", "hit", "paid", "balance", keys=["race_id"], digits=4)


@query("predicted_success", f"""WITH {HARVILLE}, x AS (SELECT t.*, CASE WHEN i <= 3 AND j <= 4 THEN 3000.0 * i ELSE 0 END + CASE WHEN i <= 5 AND j <= 5 AND k <= 6 THEN 2500.0 * k ELSE 0 END AS total FROM tensor t) SELECT race_id, round(sum(CASE WHEN total >= 10000 THEN prob ELSE 0 END), 6) AS success FROM x GROUP BY 1""")
def _success(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d)
    t = market.finish_tensor(m)
    two = t.where("i <= 3 and j <= 4").select("race_id", F.lit("exacta").alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), F.lit(None).cast("long").alias("c"), (3000.0 * F.col("i")).alias("pay")).distinct()
    three = t.where("i <= 5 and j <= 5 and k <= 6").select("race_id", F.lit("trifecta").alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("c"), (2500.0 * F.col("k")).alias("pay"))
    return out(betting.success(t, two.unionByName(three), 10_000), "success", keys=["race_id"])


SWEEP_SQL = RACE_SQL.replace(", t AS", DIFFICULTY_SQL.removeprefix(MODEL_SQL) + ", t0 AS") + f""", tt AS (SELECT t0.*, round(d.entropy, 9) AS entropy, round(d.top, 9) AS top, {HIT.format(a=2, b=3, c=4)} AS h FROM t0 JOIN d USING (race_id)),
 l AS (SELECT h, unnest([{{'m': 'entropy', 'v': entropy}}, {{'m': 'top', 'v': top}}]) AS u FROM tt)"""


@query("threshold_sweep", f"""WITH {SWEEP_SQL}, kp AS (SELECT unnest([1.0, 0.75, 0.5, 0.25]) AS keep), e AS (SELECT u.m AS m, keep, quantile_cont(u.v, 0.0) AS z, CASE keep WHEN 1.0 THEN quantile_cont(u.v, 1.0) WHEN 0.75 THEN quantile_cont(u.v, 0.75) WHEN 0.5 THEN quantile_cont(u.v, 0.5) ELSE quantile_cont(u.v, 0.25) END AS lo,
  CASE keep WHEN 1.0 THEN quantile_cont(u.v, 0.0) WHEN 0.75 THEN quantile_cont(u.v, 0.25) WHEN 0.5 THEN quantile_cont(u.v, 0.5) ELSE quantile_cont(u.v, 0.75) END AS hi FROM l, kp GROUP BY 1, 2),
 c AS (SELECT e.m AS metric, s.side, keep, h FROM l JOIN e ON e.m = u.m, (SELECT unnest(['high', 'low']) AS side) s WHERE (s.side = 'high' AND u.v >= hi) OR (s.side = 'low' AND u.v <= lo)), g AS (SELECT metric, side, keep, count(*) AS n, sum(h) AS hits FROM c GROUP BY 1, 2, 3)
 SELECT metric, side, CAST(keep AS DOUBLE) AS keep, n, CAST(hits AS BIGINT) AS hits, round(hits / n, 6) AS rate, round({_bound('hits', 'n', False)}, 6) AS low, round({_bound('hits', 'n', True)}, 6) AS high FROM g WHERE n >= 30""")  # fmt: skip
def _thresholds(s: SparkSession, d: str) -> DataFrame:
    k = ranked(s, d)
    t = bets.race_table(k).join(bets.difficulty(k, "p").select("race_id", F.round("entropy", 9).alias("entropy"), F.round("top", 9).alias("top")), "race_id")
    return out(betting.sweep(t, ["entropy", "top"], [1.0, 0.75, 0.5, 0.25], hit(2, 3, 4)), "side", "keep", "n", "hits", "rate", "low", "high", keys=["metric"])


@query("condition_folds", f"""WITH {RACE_SQL}, f AS (SELECT race_id, field, sqrt(payout) AS v, race_id % 3 AS fold FROM t), a AS (SELECT f.* FROM f JOIN (SELECT fold, quantile_cont(v, 0.4) AS q FROM f GROUP BY 1) e USING (fold) WHERE v >= q), b AS (SELECT a.* FROM a JOIN (SELECT fold, quantile_cont(field, 0.5) AS q FROM a GROUP BY 1) e USING (fold) WHERE field <= q)
 SELECT fold, count(*) AS n, round(min(v), 4) AS least, round(max(v), 4) AS most FROM b GROUP BY 1""")  # fmt: skip
def _condition(s: SparkSession, d: str) -> DataFrame:
    f = bets.race_table(ranked(s, d)).select("race_id", "field", F.sqrt("payout").alias("v"), (F.col("race_id") % 3).alias("fold"))
    kept = betting.condition(f, [("v", True, 0.6), ("field", False, 0.5)], "fold")
    return kept.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))


@query("target_sensitivity", f"WITH {RACE_SQL}, x AS (SELECT unnest([50000.0, 100000.0, 200000.0]) AS target, CASE WHEN {HIT.format(a=2, b=3, c=4)} = 1 THEN payout ELSE 0 END AS p FROM t) SELECT CAST(target AS DOUBLE) AS target, count(*) AS n, count(*) FILTER (p >= target) AS hot FROM x GROUP BY 1")
def _sensitivity(s: SparkSession, d: str) -> DataFrame:
    return out(betting.sensitivity(bets.race_table(ranked(s, d)), hit(2, 3, 4) == 1, [50_000, 100_000, 200_000]), "n", "hot", keys=["target"])


@query("grade_breakdown", f"WITH {RACE_SQL} SELECT coalesce(grade, 'all') AS grade, count(*) AS n, CAST(sum({HIT.format(a=2, b=3, c=4)}) AS BIGINT) AS hits FROM t GROUP BY ROLLUP (grade)")
def _breakdown(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).rollup("grade").agg(F.count("*").alias("n"), F.sum(hit(2, 3, 4)).alias("hits"))
    return out(t.withColumn("grade", F.coalesce("grade", F.lit("all"))), "n", "hits", keys=["grade"])


@query("rebalance", f"""WITH {CARDS}, b AS (SELECT race_id, post_no AS bet, CAST(100 * (horse_id % 30 + 1) AS BIGINT) AS stake, CASE WHEN horse_id % 9 > 0 THEN round(win_odds, 3) END AS odds FROM cards WHERE post_no <= 8),
 n AS (SELECT *, CAST(ceil(round(10000 / (odds * 100), 6)) AS BIGINT) AS need, odds * stake < 10000 - 1e-6 AS short FROM b),
 k AS (SELECT *, CASE WHEN short THEN greatest(need - stake // 100, 0) ELSE 0 END AS lack, CASE WHEN NOT short THEN greatest(stake // 100 - greatest(need, 1), 0) ELSE 0 END AS spare FROM n),
 t AS (SELECT *, sum(spare) OVER (PARTITION BY race_id) AS offer, sum(lack) OVER (PARTITION BY race_id) AS asked, coalesce(sum(lack) OVER (PARTITION BY race_id ORDER BY CASE WHEN lack > 0 THEN need * 100 - stake END NULLS LAST, bet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM k),
 u AS (SELECT race_id, bet, odds * (stake - 100 * g) - 10000 AS price, g, asked FROM t, LATERAL (SELECT unnest(range(0, CAST(spare AS BIGINT))) AS g)),
 s AS (SELECT race_id, bet, count(*) AS given FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY price DESC, bet, g) <= asked) GROUP BY ALL)
 SELECT t.race_id, t.bet, stake, odds, CAST(stake + 100 * (least(lack, greatest(offer - earlier, 0)) - coalesce(given, 0)) AS BIGINT) AS new_stake FROM t LEFT JOIN s USING (race_id, bet)""")  # fmt: skip
def _rebalance(s: SparkSession, d: str) -> DataFrame:
    c = cards(s, d).select("race_id", F.col("post_no").alias("bet"), (100 * (F.col("horse_id") % 30 + 1)).cast("long").alias("stake"), F.when(F.col("horse_id") % 9 > 0, F.round("win_odds", 3)).alias("odds"))
    return betting.rebalance(c.where("bet <= 8"), 10_000)


@query("mixed_plan")
def _mixed(s: SparkSession, d: str) -> DataFrame:
    return betting.mixed_plan(priced(s, d), "p", 12_000, 50_000, 6)
