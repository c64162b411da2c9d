"""Queries of the sources: records decoded, versions of partitions, and tables that have been text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.plans.base import out, query
from furlong.session import new_path
from furlong.sources import records, stores, texts
from furlong.sources.views import RUNS, runs


def odds_records(s: SparkSession, d: str) -> DataFrame:
    """Win odds of a race as one fixed-width record, some odds void, some records cut off or of another type."""
    layout = records.ODDS_LAYOUTS["O1"]
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    odds10 = F.round(F.col("win_odds") * 10).cast("long")
    shown = F.when(odds10 % 11 == 0, "----").when(odds10 % 13 == 0, "****").when(odds10 % 17 == 0, "0000").otherwise(pad(odds10, 4))
    group = F.concat(pad(F.col("post_no"), 2), shown, pad(F.col("finish_rank"), 2))
    # a race's runners are bounded by the rules of racing
    races = runs(s, d).groupBy("race_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("post_no", group.alias("g")))), lambda x: x["g"])).alias("groups"), F.first("race_date").alias("on"))
    day, rid = F.date_format("on", "yyyyMMdd"), F.col("race_id")
    code = F.when(rid % 19 == 0, "O9").otherwise("O1")
    head = F.concat(code, (rid % 5 + 1).cast("string"), day, day, pad(rid % 1_000_000, 6), pad(rid % 12 + 1, 2), F.when(rid % 2 == 0, "01021530").otherwise(" " * 8))
    whole = F.rpad(F.concat(F.rpad(head, layout.at - 1, " "), "groups"), layout.length, " ")
    return races.select("race_id", F.when(rid % 23 == 0, F.substring(whole, 1, 200)).otherwise(whole).cast("binary").alias("raw"))


@query("decoded_odds", f"""WITH {RUNS}, o AS (SELECT *, CAST(round(win_odds * 10) AS BIGINT) AS o10 FROM runs WHERE race_id % 19 <> 0 AND race_id % 23 <> 0)
 SELECT race_id, post_no AS combo, CASE WHEN o10 % 11 <> 0 AND o10 % 13 <> 0 AND o10 % 17 <> 0 THEN o10 END AS odds10, finish_rank AS popularity, CAST(race_id % 5 + 1 AS VARCHAR) AS state, strftime(race_date, '%Y%m%d') AS date, CASE WHEN race_id % 2 = 0 THEN '01021530' ELSE '' END AS announced FROM o""")  # fmt: skip
def _decoded(s: SparkSession, d: str) -> DataFrame:
    found = records.decode(odds_records(s, d)).where("bad is null").select("race_id", "state", "date", "announced", records.each_group())
    return found.where("g is not null").select("race_id", "g.combo", "g.odds10", "g.popularity", "state", "date", "announced")


@query("unreadable_records", f"WITH {RUNS} SELECT CASE WHEN race_id % 19 = 0 THEN 'unknown type' ELSE 'too short' END AS bad, count(DISTINCT race_id) AS n FROM runs WHERE race_id % 19 = 0 OR race_id % 23 = 0 GROUP BY 1")
def _unreadable(s: SparkSession, d: str) -> DataFrame:
    return records.decode(odds_records(s, d)).where("bad is not null").groupBy("bad").agg(F.count("*").alias("n"))


@query("stored_versions", f"""WITH {RUNS}, v AS (SELECT grade, year(race_date) AS y, race_id, post_no, price, 1 AS version FROM runs UNION ALL SELECT grade, year(race_date), race_id, post_no, price + 1, 2 FROM runs WHERE grade = '1-URGENT' AND year(race_date) >= 1996),
 n AS (SELECT grade, y, max(version) AS version FROM v GROUP BY 1, 2) SELECT grade, CAST(y AS BIGINT) AS y, version, count(*) AS n, round(sum(price), 2) AS total FROM v JOIN n USING (grade, y, version) GROUP BY 1, 2, 3""")  # fmt: skip
def _versions(s: SparkSession, d: str) -> DataFrame:
    first = runs(s, d).select("grade", F.year("race_date").alias("y"), "race_id", "post_no", "price", F.lit(1).alias("version"))
    path, by = new_path(s, "store"), ["grade", "y"]
    stores.write(first, path, "first", by)
    second = first.where("grade = '1-URGENT' and y >= 1996").withColumns({"price": F.col("price") + 1, "version": F.lit(2)})
    for _ in range(2):  # the second time changes nothing
        stores.write(second, path, "second", by)
    found = stores.read(s, path, first.schema, by).groupBy("grade", "y", "version").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    return out(found, "y", "version", "n", "total", keys=["grade"], digits=2)


@query("results_from_text", f"WITH {RUNS} SELECT race_id, race_date, post_no, horse_id, finish_rank, round(win_odds, 6) AS win_odds, grade FROM runs")
def _from_text(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "results")
    r = runs(s, d)
    # columns in another order, a mark at the beginning of the header, numbers with a fraction of 0
    r.select(F.col("grade").alias("﻿grade"), "win_odds", F.col("finish_rank").cast("double").alias("finish_rank"), "race_date", "horse_id", "post_no", "race_id", "price").write.csv(path, header=True)
    return out(texts.results(s, path), "race_date", "horse_id", "finish_rank", "win_odds", "grade")
