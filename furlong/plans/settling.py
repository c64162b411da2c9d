"""Queries of hypotheses, of the grid of probabilities and plans, and of boxes against results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import bets, hypotheses, market, settling
from furlong.plans.base import out, query
from furlong.plans.models import HIT, _bound, hit
from furlong.plans.registry import MODEL_SQL, RACE_SQL, ranked
from furlong.sources.views import RUNS, runs

GRADED = "grade IN ('1-URGENT', '2-HIGH')"
FOLD_SQL = f"{RACE_SQL}, u AS (SELECT *, race_id % 3 AS fold, {GRADED} AS graded, {HIT.format(a=2, b=3, c=4)} AS h FROM t)"
RATE_SQL = f"n, CAST(hits AS BIGINT) AS hits, round(hits / n, 6) AS rate, round({_bound('hits', 'n', False)}, 6) AS low, round({_bound('hits', 'n', True)}, 6) AS high"
RATES = ["n", "hits", "rate", "low", "high"]


def folds(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d))
    return t.withColumns({"fold": F.col("race_id") % 3, "graded": F.col("grade").isin("1-URGENT", "2-HIGH"), "h": hit(2, 3, 4)})


@query("segment_by_fold", f"""WITH {FOLD_SQL} SELECT fold, count(*) FILTER (graded) AS n_in, CAST(sum(h) FILTER (graded) AS BIGINT) AS hits_in, count(*) FILTER (NOT graded) AS n_out, CAST(sum(h) FILTER (NOT graded) AS BIGINT) AS hits_out,
 round(avg(h) FILTER (graded), 6) AS rate_in, round(avg(h) FILTER (NOT graded), 6) AS rate_out, avg(h) FILTER (graded) > avg(h) FILTER (NOT graded) AS better FROM u GROUP BY 1""")  # fmt: skip
def _segments(s: SparkSession, d: str) -> DataFrame:
    return out(hypotheses.segment_by_fold(folds(s, d), "fold", F.col("graded"), F.col("h")), "n_in", "hits_in", "n_out", "hits_out", "rate_in", "rate_out", "better", keys=["fold"])


@query("segment_test", f"""WITH {FOLD_SQL}, b AS (SELECT fold, avg(h) FILTER (graded) > avg(h) FILTER (NOT graded) AS w FROM u GROUP BY 1), c AS (SELECT count(*) FILTER (graded) AS na, sum(h) FILTER (graded) AS ha, count(*) FILTER (NOT graded) AS nb, sum(h) FILTER (NOT graded) AS hb FROM u),
 e AS (SELECT *, ha / na AS a, hb / nb AS b, sqrt((ha + hb) / (na + nb) * (1 - (ha + hb) / (na + nb)) * (1 / na + 1 / nb)) AS se, {_bound('ha', 'na', False)} AS la, {_bound('ha', 'na', True)} AS ua, {_bound('hb', 'nb', False)} AS lb, {_bound('hb', 'nb', True)} AS ub FROM c)
 SELECT (SELECT count(*) FROM b) AS folds, (SELECT count(*) FILTER (w) FROM b) AS better, round(a - b, 6) AS difference, round((a - b) / se, 6) AS z, round(a - b - sqrt(pow(a - la, 2) + pow(ub - b, 2)), 6) AS low, round(a - b + sqrt(pow(ua - a, 2) + pow(b - lb, 2)), 6) AS high FROM e""")  # fmt: skip
def _segment_test(s: SparkSession, d: str) -> DataFrame:
    found = hypotheses.segment_test(hypotheses.segment_by_fold(folds(s, d), "fold", F.col("graded"), F.col("h")))
    return out(found, "better", "difference", "z", "low", "high", keys=["folds"])


PLANS = {"narrow": (1, 2, 3), "middle": (2, 3, 4), "wide": (3, 4, 6)}
PLANS_FOLD_SQL = f"{FOLD_SQL}, v AS (" + " UNION ALL ".join(f"SELECT fold, '{n}' AS plan, {k} AS number, {HIT.format(a=a, b=b, c=c)} AS x FROM u" for k, (n, (a, b, c)) in enumerate(PLANS.items())) + "), g AS (SELECT fold, plan, number, count(*) AS n, sum(x) AS hits FROM v GROUP BY ALL)"


def plans_by_fold(s: SparkSession, d: str) -> DataFrame:
    return hypotheses.plans_by_fold(folds(s, d), "fold", {n: hit(*k) for n, k in PLANS.items()})


@query("plans_by_fold", f"WITH {PLANS_FOLD_SQL} SELECT fold, plan, {RATE_SQL} FROM g")
def _plans(s: SparkSession, d: str) -> DataFrame:
    return out(plans_by_fold(s, d), *RATES, keys=["fold", "plan"])


@query("best_plans", f"""WITH {PLANS_FOLD_SQL}, r AS (SELECT *, round(hits / n, 12) AS rate, round({_bound('hits', 'n', False)}, 12) AS low FROM g)
 SELECT fold, (SELECT plan FROM r x WHERE x.fold = f.fold ORDER BY rate DESC, number LIMIT 1) AS by_rate, (SELECT plan FROM r x WHERE x.fold = f.fold ORDER BY low DESC, number LIMIT 1) AS by_low FROM (SELECT DISTINCT fold FROM r) f""")  # fmt: skip
def _best(s: SparkSession, d: str) -> DataFrame:
    return hypotheses.best_plans(plans_by_fold(s, d), "fold")


@query("conditions_test", f"""WITH {FOLD_SQL}, q AS (SELECT *, sqrt(payout) AS v FROM u), e AS (SELECT fold, quantile_cont(v, 0.4) AS qv, quantile_cont(field, 0.5) AS qf FROM q GROUP BY 1),
 c AS (SELECT 'all' AS condition, fold, h FROM q UNION ALL SELECT 'large', fold, h FROM q JOIN e USING (fold) WHERE v >= qv UNION ALL SELECT 'small field', fold, h FROM q JOIN e USING (fold) WHERE field <= qf),
 g AS (SELECT condition, fold, count(*) AS n, sum(h) AS hits FROM c GROUP BY ALL), r AS (SELECT *, hits / n AS rate, {_bound('hits', 'n', False)} AS low FROM g)
 SELECT a.condition, count(*) AS folds, count(*) FILTER (a.low > b.low) AS low_better, count(*) FILTER (a.rate > b.rate) AS rate_better, round(avg(a.n), 4) AS mean_n, bool_and(a.low > b.low) AS consistent FROM r a JOIN r b ON b.condition = 'all' AND a.fold = b.fold WHERE a.condition <> 'all' GROUP BY 1""")  # fmt: skip
def _conditions(s: SparkSession, d: str) -> DataFrame:
    t = folds(s, d).withColumn("v", F.sqrt("payout"))
    found = hypotheses.conditions_by_fold(t, "fold", {"large": [("v", True, 0.6)], "small field": [("field", False, 0.5)]}, F.col("h"))
    return out(hypotheses.conditions_test(found, "fold"), "folds", "low_better", "rate_better", "mean_n", "consistent", keys=["condition"], digits=4)


GRID_PLANS = {"box": (5, 5, 5), "nested": (2, 3, 5)}
GRID_SQL = f"""{RUNS}, b AS (SELECT race_id, post_no, finish_rank, payout, 1 / win_odds / sum(1 / win_odds) OVER (PARTITION BY race_id) AS market, CASE WHEN race_id % 7 > 0 OR post_no > 1 THEN (horse_id % 11 + 1) / 12 END AS other FROM runs),
 x AS (SELECT race_id, post_no, finish_rank, payout, 'market' AS source, market AS p FROM b UNION ALL SELECT race_id, post_no, finish_rank, payout, 'other', other FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY race_id, source ORDER BY round(p, 12) DESC, post_no) AS k, bool_and(p IS NOT NULL) OVER (PARTITION BY race_id, source) AS ok FROM x),
 t AS (SELECT race_id, source, count(*) AS field, min(payout) AS payout, min(k) FILTER (finish_rank = 1) AS r1, min(k) FILTER (finish_rank = 2) AS r2, min(k) FILTER (finish_rank = 3) AS r3 FROM k WHERE ok GROUP BY ALL HAVING count(*) >= 3),
 h AS ({' UNION ALL '.join(f"SELECT source, '{n}' AS plan, {HIT.format(a=a, b=b, c=c)} AS h, payout, least({a}, field) * (least({b}, field) - 1) * (least({c}, field) - 2) AS pts FROM t" for n, (a, b, c) in GRID_PLANS.items())}),
 g AS (SELECT source, plan, count(*) AS races, sum(h) AS hits, count(*) FILTER (h = 1 AND payout >= 150000) AS hot, sum(pts) * 100 AS stake, sum(CASE WHEN h = 1 THEN payout ELSE 0 END) AS paid FROM h GROUP BY ALL)"""  # fmt: skip


@query("evaluated_grid", f"WITH {GRID_SQL} SELECT source, plan, races, CAST(hits AS BIGINT) AS hits, hot, CAST(stake AS BIGINT) AS stake, round(paid, 2) AS paid, round(hot / races, 6) AS rate, round({_bound('hot', 'races', False)}, 6) AS low, round({_bound('hot', 'races', True)}, 6) AS high, round(round(paid, 2) / stake, 6) AS roi FROM g")
def _grid(s: SparkSession, d: str) -> DataFrame:
    other = F.when((F.col("race_id") % 7 > 0) | (F.col("post_no") > 1), (F.col("horse_id") % 11 + 1) / 12)
    df = market.market_probability(runs(s, d), name="market").withColumn("other", other)
    found = settling.evaluate_grid(df, ["market", "other"], GRID_PLANS, 150_000).withColumn("paid", F.round("paid", 2))
    return out(found.withColumn("roi", F.col("paid") / F.col("stake")), "races", "hits", "hot", "stake", "paid", "rate", "low", "high", "roi", keys=["source", "plan"])


@query("reconciled", f"""WITH {MODEL_SQL}, p AS (SELECT race_id, post_no, model_rank FROM k WHERE model_rank <= 4), r AS (SELECT race_id, post_no, CASE WHEN horse_id % 9 = 0 THEN '1' ELSE '0' END AS state FROM runs WHERE race_id % 29 > 0 AND NOT (post_no = 2 AND race_id % 10 = 0)),
 w AS (SELECT race_id, max(post_no) FILTER (finish_rank = 1) AS a, max(post_no) FILTER (finish_rank = 2) AS b, max(post_no) FILTER (finish_rank = 3) AS c, max(payout) AS pay FROM runs WHERE race_id % 37 > 0 GROUP BY 1 HAVING count(*) >= 3),
 mm AS (SELECT p.race_id, p.post_no, r.post_no IS NOT NULL AND state <> '1' AS ran, coalesce(state = '1', false) AS back, r.post_no IS NULL AS gone FROM p LEFT JOIN r USING (race_id, post_no)),
 g AS (SELECT race_id, count(*) FILTER (ran) AS n, count(*) FILTER (back) AS refunded, count(*) FILTER (gone) AS missing, coalesce(list(post_no) FILTER (ran), []) AS box FROM mm GROUP BY 1),
 s AS (SELECT g.*, w.a, CASE WHEN list_has_all(box, [w.a, w.b, w.c]) THEN pay ELSE 0 END + CASE WHEN g.race_id % 5 = 0 AND list_has_all(box, [1, 2, 3]) THEN 1000 ELSE 0 END AS paid, CASE WHEN n >= 3 THEN n * (n - 1) * (n - 2) * 100 ELSE 0 END AS stake,
  CASE WHEN g.race_id % 31 = 0 THEN 'cancelled' WHEN g.race_id % 29 = 0 OR NOT EXISTS (SELECT 1 FROM r WHERE r.race_id = g.race_id) THEN 'pending' WHEN w.race_id IS NULL THEN 'no payout' ELSE 'checked' END AS state FROM g LEFT JOIN w USING (race_id))
 SELECT race_id, state, n AS runners, refunded, missing, CASE WHEN state = 'checked' THEN CAST(stake AS BIGINT) END AS stake, CASE WHEN state = 'checked' THEN paid > 0 END AS hit, CASE WHEN state = 'checked' THEN round(paid, 4) END AS paid, CASE WHEN state = 'checked' THEN paid >= 50000 END AS hot, CASE WHEN state = 'checked' THEN round(paid - stake, 4) END AS balance FROM s""")  # fmt: skip
def _reconciled(s: SparkSession, d: str) -> DataFrame:
    k = ranked(s, d)
    r = k.where("race_id % 29 > 0 and not (post_no = 2 and race_id % 10 = 0)").select("race_id", "post_no", F.when(F.col("horse_id") % 9 == 0, "1").otherwise("0").alias("state"))
    at = lambda n: F.max(F.when(F.col("finish_rank") == n, F.col("post_no")))
    w = k.where("race_id % 37 > 0").groupBy("race_id").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), F.max("payout").alias("pay"), F.count("*").alias("n")).where("n >= 3")
    own = F.struct("a", "b", "c", F.col("pay").cast("double").alias("pay"))
    second = F.struct(*(F.lit(v).cast("long").alias(x) for v, x in ((1, "a"), (2, "b"), (3, "c"))), F.lit(1000.0).alias("pay"))
    payouts = w.select("race_id", F.when(F.col("race_id") % 5 == 0, F.array(own, second)).otherwise(F.array(own)).alias("combos"))
    races = k.select("race_id", (F.col("race_id") % 31 == 0).alias("cancelled")).distinct()
    found = settling.reconcile(k.select("race_id", "post_no", "model_rank"), r, payouts, races, 4)
    return out(found, "state", "runners", "refunded", "missing", "stake", "hit", "paid", "hot", "balance", keys=["race_id"], digits=4)


@query("replacement_plan")
def _replacement(s: SparkSession, d: str) -> DataFrame:
    t = folds(s, d)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("plan"), hit(*k).alias("hit")) for n, k in PLANS.items())))
    return out(hypotheses.replacement(t.select("race_id", each.alias("x")).select("race_id", "x.*"), "narrow"), "n", "only_plan", "only_base", "difference", "low", "high", "p_value", "own_rate", "passes", "chosen", keys=["plan"])


