"""Queries of typing, versions, joins and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.functions import codes
from furlong.operators import datasets as ds
from furlong.plans.base import out, query
from furlong.plans.registry import PRIORITY, PRIORITY_SQL
from furlong.session import parts
from furlong.sources.views import CARDS, FIELDS, RUNS, VERSIONS, cards, fields, runs, table, versions


@query("typed_runs", f"""WITH {FIELDS}, c AS (SELECT race_id, line, TRY_CAST(trim(size) AS DOUBLE) AS rank, TRY_CAST(trim(time) AS DOUBLE) AS seconds, CASE WHEN q % 3 > 0 THEN CAST(q AS DOUBLE) END AS change FROM fields)
 SELECT race_id, line, CAST(rank AS BIGINT) AS rank, seconds, coalesce(change, 0) AS change, CAST(CASE WHEN rank = 1 THEN 1 ELSE 0 END AS BIGINT) AS won FROM c WHERE rank IS NOT NULL AND seconds IS NOT NULL""")  # fmt: skip
def _typed(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d).select("race_id", "line", F.col("size").alias("rank"), F.col("time").alias("seconds"), F.when(F.col("q") % 3 > 0, F.col("q").cast("string")).alias("change"))
    return out(ds.typed_runs(f, ["rank", "seconds", "change"]), "rank", "seconds", "change", "won", keys=["race_id", "line"])


@query("typed_entries", f"""WITH {FIELDS} SELECT race_id, line, CAST(TRY_CAST(trim(size) AS DOUBLE) AS BIGINT) AS rank, TRY_CAST(trim(hhmm) AS DOUBLE) AS seconds, CAST(CASE WHEN TRY_CAST(trim(size) AS DOUBLE) = 1 THEN 1 WHEN TRY_CAST(trim(size) AS DOUBLE) IS NOT NULL THEN 0 END AS BIGINT) AS won FROM fields""")
def _entries_typed(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d).select("race_id", "line", F.col("size").alias("rank"), F.col("hhmm").alias("seconds"), F.lit("1").alias("change"))
    return out(ds.typed_runs(f, ["rank", "seconds", "change"], results=False), "rank", "seconds", "won", keys=["race_id", "line"])


@query("money_fields", f"""WITH {FIELDS} SELECT race_id, line, CASE WHEN q % 7 = 0 THEN NULL ELSE CAST(part AS DOUBLE) END AS amount FROM fields""")
def _money(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("q") % 7 == 0, "-").otherwise(F.concat(F.format_number(F.col("part"), 0), F.lit("円")))
    return fields(s, d).select("race_id", "line", ds.money(t).alias("amount"))


@query("time_split", f"WITH {RUNS}, e AS (SELECT quantile_cont(day, 0.8) AS e FROM runs) SELECT CASE WHEN day <= e THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(day) AS first, max(day) AS last FROM runs, e GROUP BY 1")
def _split(s: SparkSession, d: str) -> DataFrame:
    return ds.split_at(runs(s, d), "day", 0.8).groupBy("part").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("years_between", f"WITH {RUNS} SELECT CAST(year(race_date) AS BIGINT) AS year, count(*) AS n FROM runs WHERE year(race_date) BETWEEN 1994 AND 1996 GROUP BY 1")
def _years(s: SparkSession, d: str) -> DataFrame:
    return ds.years_between(runs(s, d), "race_date", 1994, 1996).groupBy(F.year("race_date").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("central_only", f"""WITH {VERSIONS} SELECT race_id, line, state FROM (SELECT *, lpad(CAST(race_id % 14 AS VARCHAR), 2, '0') AS venue, CASE WHEN seq % 5 = 0 THEN 'A' WHEN seq % 7 = 0 THEN NULL ELSE state END AS s FROM versions) WHERE venue BETWEEN '01' AND '10' AND coalesce(s, '') NOT IN ('A', 'B')""")
def _central(s: SparkSession, d: str) -> DataFrame:
    v = versions(s, d).withColumns({"venue": F.lpad((F.col("race_id") % 14).cast("string"), 2, "0"), "s": F.when(F.col("seq") % 5 == 0, "A").when(F.col("seq") % 7 == 0, None).otherwise(F.col("state"))})
    return ds.central_only(v, "venue", "s").select("race_id", "line", "state")


@query("confirmed_versions", f"""WITH {VERSIONS}, p AS (SELECT *, state IN ('5', '6', '7') AS c, coalesce({PRIORITY_SQL}, -1) AS p FROM versions)
 SELECT race_id, line, state, seq, count(*) OVER (PARTITION BY race_id, line) AS n_versions FROM p QUALIFY row_number() OVER (PARTITION BY race_id, line ORDER BY c DESC, made DESC, p DESC, seq DESC) = 1""")  # fmt: skip
def _confirmed(s: SparkSession, d: str) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    found = ds.best_versions(versions(s, d), ["race_id", "line"], F.col("state").isin("5", "6", "7"), rank[F.col("state")])
    return out(found, "state", "seq", "n_versions", keys=["race_id", "line"])


@query("odds_versions", f"""WITH {VERSIONS}, o AS (SELECT race_id, 'k' || line % 2 AS kind, state, made, line * 100 + seq AS seq, value FROM versions WHERE state IN ('4', '5'))
 SELECT race_id, kind, state, seq, round(value, 4) AS value, count(*) OVER (PARTITION BY race_id, kind) AS n_versions FROM o QUALIFY row_number() OVER (PARTITION BY race_id, kind ORDER BY state DESC, made DESC, seq DESC) = 1""")  # fmt: skip
def _odds(s: SparkSession, d: str) -> DataFrame:
    v = versions(s, d).select("race_id", F.concat(F.lit("k"), (F.col("line") % 2).cast("string")).alias("kind"), "state", "made", (F.col("line") * 100 + F.col("seq")).alias("seq"), "value")
    return out(ds.odds_versions(v, F.col("state").try_cast("int"), final_only=True), "state", "seq", "value", "n_versions", keys=["race_id", "kind"], digits=4)


@query("odds_counts", f"WITH {VERSIONS} SELECT 'k' || line % 2 AS kind, state, count(*) AS records, count(DISTINCT race_id) AS races FROM versions GROUP BY 1, 2")
def _odds_counts(s: SparkSession, d: str) -> DataFrame:
    return versions(s, d).groupBy(F.concat(F.lit("k"), (F.col("line") % 2).cast("string")).alias("kind"), "state").agg(F.count("*").alias("records"), F.count_distinct("race_id").alias("races"))


PREP_SQL = f"""{FIELDS}, g AS (SELECT race_id, line, part, supp, q, CASE WHEN TRY_CAST(track AS INT) BETWEEN 10 AND 22 THEN 'turf' WHEN TRY_CAST(track AS INT) IN (23, 24, 25, 26, 29) THEN 'dirt' END AS surface, CASE WHEN q % 4 > 0 THEN 't' || q % 4 END AS turf, CASE WHEN part % 5 > 0 THEN 'd' || part % 5 END AS dirt,
 CASE WHEN part % 3 = 0 THEN CAST(q AS DOUBLE) END AS official, CASE WHEN q % 2 = 0 THEN part / 10 END AS derived FROM fields)"""


@query("prepared_races", f"""WITH {PREP_SQL} SELECT race_id, line, surface, coalesce(CASE WHEN surface = 'dirt' THEN dirt ELSE turf END, dirt) AS going, round(coalesce(official, derived), 4) AS first3, CASE WHEN official IS NOT NULL THEN 'official' WHEN derived IS NOT NULL THEN 'laps' ELSE 'none' END AS origin
 FROM g WHERE supp % 8 IN (5, 6, 7)""")  # fmt: skip
def _races(s: SparkSession, d: str) -> DataFrame:
    f = fields(s, d).where((F.col("supp") % 8).cast("string").isin(*ds.FINAL_STATES))
    text = lambda p, c: F.when(c > 0, F.concat(F.lit(p), c.cast("string")))
    surface = codes.track_surface(F.col("track"))
    f = f.withColumn("surface", F.when(surface.isin("turf", "dirt"), surface))
    value, origin = ds.with_origin(F.when(F.col("part") % 3 == 0, F.col("q").cast("double")), F.when(F.col("q") % 2 == 0, F.col("part") / 10))
    return f.select("race_id", "line", "surface", ds.going(F.coalesce(F.col("surface"), F.lit("")), text("t", F.col("q") % 4), text("d", F.col("part") % 5)).alias("going"), F.round(value, 4).alias("first3"), origin.alias("origin"))


@query("final_runners", f"""WITH {RUNS}, r AS (SELECT DISTINCT o_orderkey AS race_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 > 0), x AS (SELECT *, CASE WHEN horse_id % 9 < 6 AND horse_id % 2 = 0 THEN CAST(horse_id % 9 AS VARCHAR) END AS ab, CASE WHEN horse_id % 17 > 0 THEN finish_rank END AS fr FROM runs)
 SELECT race_id, post_no, status, fr AS finish_rank FROM x JOIN r USING (race_id) WHERE coalesce(ab, '') NOT IN ('1', '2', '3', '4', '5') AND fr IS NOT NULL""")  # fmt: skip
def _final_runners(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("race_id"), F.col("o_orderstatus").alias("status")).distinct()
    x = runs(s, d).withColumns({"ab": F.when((F.col("horse_id") % 9 < 6) & (F.col("horse_id") % 2 == 0), (F.col("horse_id") % 9).cast("string")), "finish_rank": F.when(F.col("horse_id") % 17 > 0, F.col("finish_rank"))})
    return ds.final_runners(x, r, "ab").select("race_id", "post_no", "status", "finish_rank")


@query("entries", f"""WITH {VERSIONS}, r AS (SELECT o_orderkey AS race_id, o_orderpriority AS grade FROM orders WHERE o_orderpriority < '3'), x AS (SELECT race_id, line, seq, CASE WHEN line % 6 > 0 THEN line END AS post_no, state, made, CASE WHEN seq = 2 THEN '3' END AS ab FROM versions)
 SELECT race_id, line, seq, grade, strftime(max(made) OVER (PARTITION BY race_id), '%Y-%m-%d') AS made_last, count(*) OVER (PARTITION BY race_id) = count(post_no) OVER (PARTITION BY race_id) AS drawn FROM x JOIN r USING (race_id) WHERE state IN ('1', '2') AND ab IS NULL""")  # fmt: skip
def _entries(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("race_id"), F.col("o_orderpriority").alias("grade"))
    x = versions(s, d).withColumns({"post_no": F.when(F.col("line") % 6 > 0, F.col("line")), "ab": F.when(F.col("seq") == 2, "3")})
    return ds.entries(x, r, "ab").select("race_id", "line", "seq", "grade", F.date_format("made_last", "yyyy-MM-dd").alias("made_last"), "drawn")


SLOTS_SQL = f"""{FIELDS}, sl AS (SELECT race_id, line, part, q, [{{'c': CASE WHEN q % 9 = 0 THEN '000000' ELSE lpad(CAST(part % 18 + 1 AS VARCHAR), 6, '0') END, 'p': CAST(part AS VARCHAR)}}, {{'c': CASE WHEN q % 5 = 0 THEN ' 010203' ELSE '' END, 'p': '1,5' || CAST(q % 10 AS VARCHAR) || '0円'}}, {{'c': 'x', 'p': '10'}}] AS s FROM fields),
 gd AS (SELECT *, [x for x in [{{'c': trim(y.c), 'p': TRY_CAST(replace(replace(y.p, ',', ''), '円', '') AS DOUBLE)}} for y in s] if regexp_full_match(x.c, '[0-9]+') and x.c not in ('0000', '000000') and x.p > 0] AS g FROM sl)"""


@query("payout_lists", f"""WITH {SLOTS_SQL} SELECT race_id, line, g[1].p AS payout, CAST(len(g) AS BIGINT) AS n_hits, array_to_string([x.c for x in g], ';') AS combinations, array_to_string([CAST(CAST(x.p AS BIGINT) AS VARCHAR) for x in g], ';') AS payouts,
 CASE WHEN q % 9 = 0 AND part % 2 = 0 THEN 'void' WHEN q % 9 = 0 THEN 'not sold' ELSE '' END AS reason FROM gd""")  # fmt: skip
def _payout_lists(s: SparkSession, d: str) -> DataFrame:
    t = lambda c: c.cast("string")
    first = F.when(F.col("q") % 9 == 0, "000000").otherwise(F.lpad(t(F.col("part") % 18 + 1), 6, "0"))
    slot = lambda c, p: F.struct(c.alias("combination"), p.alias("payout"))
    slots = F.array(slot(first, t(F.col("part"))), slot(F.when(F.col("q") % 5 == 0, " 010203").otherwise(""), F.concat(F.lit("1,5"), t(F.col("q") % 10), F.lit("0円"))), slot(F.lit("x"), F.lit("10")))
    return fields(s, d).select("race_id", "line", ds.payout_lists(slots).alias("l"), ds.no_payout_reason(first, F.col("part") % 2 == 0).alias("reason")).select("race_id", "line", "l.*", "reason")


@query("dataset_counts", f"""WITH {RUNS}, o AS (SELECT o_orderkey AS race_id FROM orders WHERE o_orderkey % 3 > 0), r AS (SELECT * FROM runs WHERE race_id % 5 > 0)
 SELECT 'races' AS step, (SELECT count(*) FROM o) AS before, (SELECT count(*) FROM o WHERE race_id IN (SELECT race_id FROM r)) AS kept UNION ALL SELECT 'runners', (SELECT count(*) FROM r), (SELECT count(*) FROM r WHERE race_id IN (SELECT race_id FROM o))""")  # fmt: skip
def _counts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("race_id")).where("race_id % 3 > 0")
    r = runs(s, d).where("race_id % 5 > 0").select("race_id", "post_no")
    races, runners = ds.both_ways(o, r)
    count = lambda name, a, b: a.agg(F.lit(name).alias("step"), F.count("*").alias("before")).crossJoin(b.agg(F.count("*").alias("kept")))
    return count("races", o, races).unionByName(count("runners", r, runners))


@query("blank_results", f"WITH {RUNS} SELECT race_id, post_no, CAST(NULL AS BIGINT) AS finish_rank, CAST(NULL AS DOUBLE) AS price, horse_id FROM runs WHERE day % 10 = 0")
def _blank(s: SparkSession, d: str) -> DataFrame:
    return ds.blank_results(runs(s, d).where("day % 10 = 0")).select("race_id", "post_no", "finish_rank", "price", "horse_id")


PRED_SQL = f"""{VERSIONS}, pr AS (SELECT race_id, CASE WHEN line % 2 = 0 THEN 'live' ELSE 'practice' END AS kind, 'f' || line || '-' || seq AS file, made, made - to_days(CAST(seq * 9 AS INT)) AS trained_until FROM versions WHERE race_id % 4 = 0),
 sc AS (SELECT o_orderkey AS race_id, CAST(o_orderdate AS TIMESTAMP) + to_days(60) AS start, CAST(o_orderdate AS TIMESTAMP) + to_days(30) AS day FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 3 > 0)"""


@query("chosen_predictions", f"""WITH {PRED_SQL}, t AS (SELECT pr.*, start, day, kind <> 'live' OR start IS NULL OR made < start AS usable, CASE WHEN kind = 'live' THEN 0 ELSE coalesce(CASE WHEN trained_until < day THEN 1 ELSE 0 END, 0) END AS unseen FROM pr LEFT JOIN sc USING (race_id)),
 n AS (SELECT kind, race_id, count(DISTINCT file) AS files FROM t GROUP BY 1, 2), b AS (SELECT kind, race_id, file FROM t WHERE usable QUALIFY row_number() OVER (PARTITION BY kind, race_id ORDER BY unseen DESC, made DESC, file DESC) = 1) SELECT kind, race_id, file, files FROM n LEFT JOIN b USING (kind, race_id)""")  # fmt: skip
def _chosen(s: SparkSession, d: str) -> DataFrame:
    v = versions(s, d).where("race_id % 4 = 0").withColumn("made", F.col("made").cast("timestamp_ntz"))
    p = v.select("race_id", F.when(F.col("line") % 2 == 0, "live").otherwise("practice").alias("kind"), F.concat(F.lit("f"), F.col("line").cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("file"), "made", (F.col("made") - F.make_dt_interval(days=(F.col("seq") * 9).cast("int"))).alias("trained_until"))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    sc = table(s, d, "orders").where("o_orderkey % 8 = 0 or o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("race_id"), (at + F.make_dt_interval(days=F.lit(60))).alias("start"), (at + F.make_dt_interval(days=F.lit(30))).alias("day"))
    return ds.choose_predictions(p, sc).select("kind", "race_id", "file", "files")


@query("prediction_log", "SELECT l_orderkey AS race_id, l_linenumber AS horse, round(l_quantity, 4) AS predicted, o.o_orderstatus AS result FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 > 0) o ON l_orderkey = o_orderkey")
def _log(s: SparkSession, d: str) -> DataFrame:
    results = table(s, d, "orders").where("o_orderkey % 6 > 0").select(F.col("o_orderkey").alias("race_id"), F.col("o_orderstatus").alias("result"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("horse"), F.round("l_quantity", 4).alias("predicted")).join(results, "race_id", "left")


@query("replaced_by_key", f"WITH {VERSIONS}, o AS (SELECT race_id, line, value, NULL AS note FROM versions WHERE seq = 1), n AS (SELECT race_id, line, value, 'new' AS note FROM versions WHERE seq = 2) SELECT race_id, line, round(value, 4) AS value, note FROM o WHERE (race_id) NOT IN (SELECT race_id FROM n) UNION ALL SELECT race_id, line, round(value, 4), note FROM n")
def _replaced(s: SparkSession, d: str) -> DataFrame:
    v = versions(s, d).select("race_id", "line", "value", "seq")
    found = ds.replace_by_key(v.where("seq = 1").drop("seq"), v.where("seq = 2").drop("seq").withColumn("note", F.lit("new")), ["race_id"])
    return out(found, "line", "value", "note", keys=["race_id"], digits=4)


@query("widened_append", "SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS segment FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 5 = 0")
def _widened(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = table(s, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return ds.append_widened(a, b)


@query("compared_tables", f"""WITH {RUNS}, a AS (SELECT race_id, post_no, price, win_odds FROM runs WHERE race_id % 7 > 0), b AS (SELECT race_id, post_no, price * CASE WHEN horse_id % 50 = 0 THEN 1.01 ELSE 1.000001 END AS price, CASE WHEN horse_id % 31 > 0 THEN win_odds END AS win_odds FROM runs WHERE race_id % 11 > 0),
 j AS (SELECT a.race_id IS NOT NULL AND b.race_id IS NOT NULL AS m, a.price AS p, b.price AS p2, a.win_odds AS w, b.win_odds AS w2 FROM a FULL JOIN b ON a.race_id = b.race_id AND a.post_no = b.post_no)
 SELECT 'price' AS "column", count(*) FILTER (m) AS n, count(*) FILTER (m AND abs(p - p2) > 1e-6 + 1e-5 * abs(p2)) AS different, count(*) FILTER (NOT m) AS alone FROM j UNION ALL SELECT 'win_odds', count(*) FILTER (m), count(*) FILTER (m AND w2 IS NULL), count(*) FILTER (NOT m) FROM j""")  # fmt: skip
def _compared(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    b = r.where("race_id % 11 > 0").withColumns({"price": F.col("price") * F.when(F.col("horse_id") % 50 == 0, 1.01).otherwise(1.000001), "win_odds": F.when(F.col("horse_id") % 31 > 0, F.col("win_odds"))})
    return ds.compare_tables(r.where("race_id % 7 > 0"), b, ["race_id", "post_no"], ["price", "win_odds"])


@query("aligned_tables", "SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM lineitem) AS rows_b, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS shared, false AS aligned")
def _aligned(s: SparkSession, d: str) -> DataFrame:
    return ds.aligned(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("unlike_names_join", "SELECT o_orderkey AS race_id, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON c_nationkey = n_nationkey")
def _unlike(s: SparkSession, d: str) -> DataFrame:
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation").where("n_regionkey > 1")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return joined.select(F.col("o_orderkey").alias("race_id"), F.col("n_name").alias("nation"))


@query("lookup_by_key", f"WITH {RUNS} SELECT race_id, post_no, s_name AS name FROM runs LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON jockey_id = s_suppkey")
def _lookup(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("jockey_id"), F.col("s_name").alias("name"))
    return runs(s, d).join(names, "jockey_id", "left").select("race_id", "post_no", "name")


@query("run_gaps", "SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap >= 900")
def _gaps(s: SparkSession, d: str) -> DataFrame:
    return ds.gaps(table(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 900)


@query("first_seen", f"WITH {CARDS} SELECT race_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM cards GROUP BY 1")
def _first(s: SparkSession, d: str) -> DataFrame:
    return ds.first_seen(cards(s, d), ["race_id"], "ts").select("race_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("repeated_entries", f"WITH {RUNS} SELECT horse_id, day, count(DISTINCT race_id) AS races FROM runs GROUP BY 1, 2 HAVING count(DISTINCT race_id) > 1")
def _repeated(s: SparkSession, d: str) -> DataFrame:
    # dealt by what is counted before it is counted, to as many tasks as the rows need (their number is in the files' footers)
    r = runs(s, d).select("horse_id", "day", "race_id").repartition(parts(table(s, d, "lineitem").count()), "horse_id", "day")
    return r.groupBy("horse_id", "day").agg(F.count_distinct("race_id").alias("races")).where("races > 1")


@query("sampled_races")
def _sampled(s: SparkSession, d: str) -> DataFrame:
    return ds.sampled(runs(s, d), "race_id", 20, 7).groupBy("race_id").agg(F.count("*").alias("runners"))


@query("ordered_report", f"""WITH {RUNS}, g AS (SELECT grade, surface, count(*) AS n FROM runs GROUP BY 1, 2) SELECT grade, surface, n, row_number() OVER (ORDER BY CASE grade WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, n DESC, grade, surface) AS place FROM g QUALIFY place <= 10""")
def _ordered(s: SparkSession, d: str) -> DataFrame:
    g = runs(s, d).groupBy("grade", "surface").agg(F.count("*").alias("n"))
    rank = F.create_map(F.lit("2-HIGH"), F.lit(1), F.lit("1-URGENT"), F.lit(2))[F.col("grade")]
    # fifteen groups, so one window orders them; ten are shown
    w = Window.orderBy(F.coalesce(rank, F.lit(3)), F.desc("n"), "grade", "surface")
    return g.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")
