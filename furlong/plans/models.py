"""Queries of tests, market models and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.operators import bets, logit, market, stats
from furlong.plans.base import out, query
from furlong.plans.registry import CARDS, HARVILLE, P_SQL, RACE_SQL, priced, ranked
from furlong.sources.views import RUNS, cards, runs

WILSON = "({h} / {n} + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) {s} 1.96 / (1 + 1.96 * 1.96 / {n}) * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))"
#: two-sided normal tail of x >= 0 by the series x^(2k+1) / (1 * 3 * ... * (2k+1))
TAIL = "CASE WHEN {x} > 8 THEN 0 WHEN {x} = 0 THEN 1 ELSE greatest(1 - 2 * list_sum([exp((2 * k + 1) * ln({x}) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)) for k in range(0, 161)]) * exp(-{x} * {x} / 2) / sqrt(2 * pi()), 0) END"
HIT = "CASE WHEN r1 <= {a} AND r2 <= {b} AND r3 <= {c} THEN 1 ELSE 0 END"


def _bound(h: str, n: str, up: bool) -> str:
    return ("least(" if up else "greatest(") + WILSON.format(h=h, n=n, s="+" if up else "-") + (", 1)" if up else ", 0)")


def hit(a: int, b: int, c: int):
    return F.coalesce(((F.col("r1") <= a) & (F.col("r2") <= b) & (F.col("r3") <= c)).cast("int"), F.lit(0))


@query("proportion_intervals", f"WITH {RACE_SQL}, g AS (SELECT grade, count(*) AS n, sum({HIT.format(a=2, b=3, c=4)}) AS h FROM t GROUP BY 1) SELECT grade, n, CAST(h AS BIGINT) AS hits, round(h / n - 1.96 * sqrt(h / n * (1 - h / n) / n), 6) AS low, round(h / n + 1.96 * sqrt(h / n * (1 - h / n) / n), 6) AS high, round({_bound('h', 'n', False)}, 6) AS wilson_low, round({_bound('h', 'n', True)}, 6) AS wilson_high FROM g")
def _intervals(s: SparkSession, d: str) -> DataFrame:
    g = bets.race_table(ranked(s, d)).groupBy("grade").agg(F.count("*").alias("n"), F.sum(hit(2, 3, 4)).alias("hits"))
    (low, high), (wl, wh) = stats.normal_interval(F.col("hits"), F.col("n")), stats.wilson(F.col("hits"), F.col("n"))
    return out(g.withColumns({"low": low, "high": high, "wilson_low": wl, "wilson_high": wh}), "n", "hits", "low", "high", "wilson_low", "wilson_high", keys=["grade"])


@query("two_proportions", f"""WITH {RACE_SQL}, u AS (SELECT *, unnest([1, 2, 3]) AS k FROM t), s AS (SELECT k, grade IN ('1-URGENT', '2-HIGH') AS g, CASE WHEN r1 <= k AND r2 <= k + 1 AND r3 <= k + 2 THEN 1 ELSE 0 END AS h FROM u),
 c AS (SELECT CAST(k AS BIGINT) AS n1, count(*) FILTER (g) AS na, sum(h) FILTER (g) AS ha, count(*) FILTER (NOT g) AS nb, sum(h) FILTER (NOT g) AS hb FROM s GROUP BY 1),
 e AS (SELECT *, ha / na AS a, hb / nb AS b, sqrt((ha + hb) / (na + nb) * (1 - (ha + hb) / (na + nb)) * (1 / na + 1 / nb)) AS se, {_bound('ha', 'na', False)} AS la, {_bound('ha', 'na', True)} AS ua, {_bound('hb', 'nb', False)} AS lb, {_bound('hb', 'nb', True)} AS ub FROM c),
 z AS (SELECT *, abs((a - b) / se) AS x FROM e)
 SELECT n1, round(a - b, 6) AS difference, round((a - b) / se, 6) AS z, round({TAIL.format(x='x')}, 6) AS p_value, round(a - b - sqrt(pow(a - la, 2) + pow(ub - b, 2)), 6) AS low, round(a - b + sqrt(pow(ua - a, 2) + pow(b - lb, 2)), 6) AS high FROM z""")  # fmt: skip
def _two(s: SparkSession, d: str) -> DataFrame:
    graded = F.col("grade").isin("1-URGENT", "2-HIGH")
    # three strategies side by side, on one pass over the races
    t = bets.race_table(ranked(s, d)).withColumn("graded", graded).withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("n1"), hit(k, k + 1, k + 2).alias("h")) for k in (1, 2, 3)))))
    c = t.groupBy("x.n1").agg(*(f(F.when(w, F.col("x.h"))).alias(n) for n, f, w in (("na", F.count, graded), ("ha", F.sum, graded), ("nb", F.count, ~graded), ("hb", F.sum, ~graded))))
    return out(c.withColumns(stats.two_proportions(F.col("ha"), F.col("na"), F.col("hb"), F.col("nb"))), "difference", "z", "p_value", "low", "high", keys=["n1"])


@query("paired_proportions", f"""WITH {RACE_SQL}, x AS (SELECT grade, {HIT.format(a=2, b=3, c=4)} AS x, {HIT.format(a=1, b=4, c=5)} AS y FROM t),
 c AS (SELECT grade, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x * y) AS DOUBLE) AS a, CAST(sum(x * (1 - y)) AS DOUBLE) AS b, CAST(sum((1 - x) * y) AS DOUBLE) AS c FROM x GROUP BY 1),
 w AS (SELECT *, n - a - b - c AS d, {_bound('(a + b)', 'n', False)} AS l1, {_bound('(a + b)', 'n', True)} AS u1, {_bound('(a + c)', 'n', False)} AS l2, {_bound('(a + c)', 'n', True)} AS u2 FROM c),
 f AS (SELECT *, (a + b) / n AS p, (a + c) / n AS q, coalesce(CASE WHEN a * d - b * c > 0 THEN greatest(a * d - b * c - n / 2, 0) ELSE a * d - b * c END / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0), 0) AS phi FROM w)
 SELECT grade, CAST(b AS BIGINT) AS only_x, CAST(c AS BIGINT) AS only_y, round(p - q, 6) + 0 AS difference, round(p - q - sqrt(greatest(pow(p - l1, 2) - 2 * phi * (p - l1) * (u2 - q) + pow(u2 - q, 2), 0)), 6) AS low,
 round(p - q + sqrt(greatest(pow(u1 - p, 2) - 2 * phi * (u1 - p) * (q - l2) + pow(q - l2, 2), 0)), 6) AS high,
 round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) for i in range(0, CAST(least(b, c) AS BIGINT) + 1)])) END, 6) AS p_value FROM f""")  # fmt: skip
def _paired(s: SparkSession, d: str) -> DataFrame:
    t = bets.race_table(ranked(s, d)).withColumns({"x": hit(2, 3, 4), "y": hit(1, 4, 5)})
    x, y = F.col("x"), F.col("y")
    c = t.groupBy("grade").agg(F.sum(x * y).alias("both"), F.sum(x * (1 - y)).alias("only_x"), F.sum((1 - x) * y).alias("only_y"), F.count("*").alias("n"))
    found = c.withColumns(stats.paired_proportions(*(F.col(k) for k in ("both", "only_x", "only_y", "n")))).withColumn("difference", F.round("difference", 6) + 0.0)
    return out(found, "only_x", "only_y", "difference", "low", "high", "p_value", keys=["grade"])


ECE = "(SELECT sum(k * abs(pp - oo)) / sum(k) FROM (SELECT floor({p} / 0.02) AS b, count(*) AS k, avg({p}) AS pp, avg(CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END) AS oo FROM {t} GROUP BY 1))"


@query("probability_sources", f"""WITH {P_SQL}, f AS (SELECT *, 1 / count(*) OVER (PARTITION BY race_id) AS flat FROM m), one AS (SELECT 'market' AS source, race_id, finish_rank, p FROM f UNION ALL SELECT 'flat', race_id, finish_rank, flat FROM f),
 e AS (SELECT source, sum(k) AS n, sum(k * abs(pp - oo)) / sum(k) AS error FROM (SELECT source, floor(p / 0.02) AS b, count(*) AS k, avg(p) AS pp, avg(CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END) AS oo FROM one GROUP BY 1, 2) GROUP BY 1)
 SELECT source, count(DISTINCT race_id) AS races, CAST(min(n) AS BIGINT) AS n, round(avg(CASE WHEN finish_rank = 1 THEN -ln(greatest(p, 1e-6)) END), 6) AS loss, round(avg(CASE WHEN finish_rank = 1 THEN p END), 6) AS winners, round(min(error), 6) AS error
 FROM one JOIN e USING (source) GROUP BY 1""")  # fmt: skip
def _sources(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumn("flat", 1 / F.count("*").over(Window.partitionBy("race_id")))
    return out(market.summary(m, "p", "market").unionByName(market.summary(m, "flat", "flat")), "races", "n", "loss", "winners", "error", keys=["source"])


@query("clean_races", f"""WITH {P_SQL}, q AS (SELECT *, CASE WHEN horse_id % 19 <> 3 THEN p END AS q, CASE WHEN horse_id % 23 = 5 THEN 1 ELSE finish_rank END AS r FROM m)
 SELECT race_id, post_no, round(q, 6) AS q FROM q WINDOW w AS (PARTITION BY race_id) QUALIFY sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) OVER w = 1 AND sum(CASE WHEN r = 2 THEN 1 ELSE 0 END) OVER w = 1 AND sum(CASE WHEN r = 3 THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = count(q) OVER w""")  # fmt: skip
def _clean(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumns({"q": F.when(F.col("horse_id") % 19 != 3, F.col("p")), "finish_rank": F.when(F.col("horse_id") % 23 == 5, 1).otherwise(F.col("finish_rank"))})
    return out(market.clean_races(m, "q"), "q")


GRID = [round(0.5 + 0.1 * k, 2) for k in range(8)]


@query("discount_grid", f"""WITH {P_SQL}, g AS (SELECT m.race_id, finish_rank, g.power, pow(p, g.power) AS v FROM m, (SELECT unnest([{', '.join(map(str, GRID))}]) AS power) g),
 r AS (SELECT race_id, power, sum(v) AS s, max(CASE WHEN finish_rank = 1 THEN v END) AS a, max(CASE WHEN finish_rank = 2 THEN v END) AS b, max(CASE WHEN finish_rank = 3 THEN v END) AS c FROM g GROUP BY 1, 2)
 SELECT CAST(power AS DOUBLE) AS power, count(*) AS races, round(sum(ln(b) - ln(s - a)), 4) AS second, round(sum(ln(c) - ln(s - a - b)), 4) AS third FROM r WHERE c IS NOT NULL GROUP BY 1""")  # fmt: skip
def _grid(s: SparkSession, d: str) -> DataFrame:
    return out(market.discount_grid(priced(s, d), "p", GRID), "races", "second", "third", keys=["power"], digits=4)


@query("stage_tensor", f"""WITH {P_SQL}, s AS (SELECT race_id, post_no AS i, p AS a, exp(0.8 * ln(p) + 0.1 * (post_no % 3)) AS g, exp(0.6 * ln(p) - 0.1 * (post_no % 2)) AS d FROM m), f AS (SELECT race_id, sum(g) AS sg, sum(d) AS sd FROM s GROUP BY 1)
 SELECT race_id, x.i AS post_no, round(sum(x.a * y.g / (sg - x.g) * z.d / (sd - x.d - y.d)), 6) AS p1, round(min(x.a * y.g / (sg - x.g) * z.d / (sd - x.d - y.d)), 9) AS least FROM s x JOIN s y USING (race_id) JOIN s z USING (race_id) JOIN f USING (race_id)
 WHERE x.i <> y.i AND x.i <> z.i AND y.i <> z.i GROUP BY 1, 2""")  # fmt: skip
def _stage(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumns({"w2": F.exp(0.8 * F.log("p") + 0.1 * (F.col("post_no") % 3)), "w3": F.exp(0.6 * F.log("p") - 0.1 * (F.col("post_no") % 2))})
    t = market.stage_tensor(m, "p", "w2", "w3")
    return t.groupBy("race_id", F.col("i").alias("post_no")).agg(F.round(F.sum("prob"), 6).alias("p1"), F.round(F.min("prob"), 9).alias("least"))


@query("trio_top3", f"""WITH {HARVILLE}, q AS (SELECT race_id, least(i, j, k) AS a, i + j + k - least(i, j, k) - greatest(i, j, k) AS b, greatest(i, j, k) AS c, 0.75 / sum(prob) AS o FROM tensor GROUP BY ALL),
 n AS (SELECT *, 1 / o / sum(1 / o) OVER (PARTITION BY race_id) AS q FROM q), e AS (SELECT race_id, a AS post_no, q FROM n UNION ALL SELECT race_id, b, q FROM n UNION ALL SELECT race_id, c, q FROM n) SELECT race_id, post_no, round(sum(q), 6) AS top3 FROM e GROUP BY 1, 2""")  # fmt: skip
def _trio(s: SparkSession, d: str) -> DataFrame:
    t = market.trios(market.strengths(priced(s, d))).withColumn("odds", 0.75 / F.col("prob"))
    return out(market.trio_top3(t, "odds"), "top3")


@query("synthetic_payout", f"""WITH {P_SQL}, r AS (SELECT race_id, max(CASE WHEN finish_rank = 1 THEN p END) AS a, max(CASE WHEN finish_rank = 2 THEN p END) AS b, max(CASE WHEN finish_rank = 3 THEN p END) AS c FROM m GROUP BY 1)
 SELECT race_id, round(a * b * c / ((1 - a) * (1 - a - b)), 9) AS prob, round(72.5 / (a * b * c / ((1 - a) * (1 - a - b))), 2) AS payout FROM r WHERE c IS NOT NULL""")  # fmt: skip
def _synthetic(s: SparkSession, d: str) -> DataFrame:
    return market.synthetic_payout(priced(s, d), "p").select("race_id", F.round("prob", 9).alias("prob"), F.round("payout", 2).alias("payout"))


@query("adjusted_probability", f"""WITH {P_SQL}, a AS (SELECT *, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.3 * coalesce(CASE WHEN horse_id % 5 < 4 THEN horse_id % 5 - 2 END, 0)))) AS a FROM m), n AS (SELECT *, a / sum(a) OVER (PARTITION BY race_id) AS np FROM a),
 k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(p, 12) DESC, post_no) AS k0, row_number() OVER (PARTITION BY race_id ORDER BY round(np, 12) DESC, post_no) AS k1 FROM n) SELECT race_id, post_no, round(np, 6) AS new_p, k0 AS rank_before, k1 AS rank_after, k0 - k1 AS moved FROM k""")  # fmt: skip
def _adjusted(s: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("horse_id") % 5 < 4, F.col("horse_id") % 5 - 2)
    return out(market.adjusted(priced(s, d), "p", score, 0.3), "new_p", "rank_before", "rank_after", "moved")


@query("paddock_skill", f"""WITH {RUNS}, s AS (SELECT *, horse_id % 7 - 3 AS score FROM runs WHERE horse_id % 11 > 0) SELECT CASE WHEN score <= -2 THEN 'poor' WHEN score <= 0 THEN 'fair' WHEN score <= 2 THEN 'good' ELSE 'best' END AS band, count(*) AS n,
 round(avg(CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN finish_rank <= 3 THEN 1 ELSE 0 END), 6) AS show_rate FROM s GROUP BY 1""")  # fmt: skip
def _paddock(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d).where("horse_id % 11 > 0").withColumn("score", F.col("horse_id") % 7 - 3)
    band = F.when(F.col("score") <= -2, "poor").when(F.col("score") <= 0, "fair").when(F.col("score") <= 2, "good").otherwise("best")
    return out(r.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg((F.col("finish_rank") == 1).cast("int")).alias("win_rate"), F.avg((F.col("finish_rank") <= 3).cast("int")).alias("show_rate")), "n", "win_rate", "show_rate", keys=["band"])


@query("conditional_logit")
def _logit(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumns({"a": F.log("p"), "b": F.col("post_no").cast("double") / 12})
    fit = logit.fit(m, ["a", "b"])
    return s.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("a", "b"), fit.beta, strict=True)], "term string, beta double")


@query("logit_walk_forward")
def _walk(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumns({"a": F.log("p"), "b": F.log(1 / F.col("post_no")), "fold": F.col("race_id") % 3})
    return out(logit.walk_forward(m, ["a", "b"], "fold", "mixed"), "mixed", "fold")


@query("logit_gradient", f"""WITH {P_SQL}, x AS (SELECT race_id, finish_rank, ln(p) AS a, post_no / 12 AS b, exp(0.9 * ln(p) - 0.2 * post_no / 12) AS e FROM m), n AS (SELECT *, e / sum(e) OVER (PARTITION BY race_id) AS q, sum(CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY race_id) AS w FROM x)
 SELECT count(DISTINCT race_id) AS races, round(sum(CASE WHEN finish_rank = 1 THEN ln(q) END), 4) AS loglik, round(sum((CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END - q) * a), 4) AS ga, round(sum((CASE WHEN finish_rank = 1 THEN 1 ELSE 0 END - q) * b), 4) AS gb FROM n WHERE w = 1""")  # fmt: skip
def _gradient(s: SparkSession, d: str) -> DataFrame:
    m = priced(s, d).withColumns({"a": F.log("p"), "b": F.col("post_no") / 12})
    t = logit.terms(m, ["a", "b"], [0.9, -0.2])
    return t.select("races", F.round("loglik", 4).alias("loglik"), F.round("g0", 4).alias("ga"), F.round("g1", 4).alias("gb"))
