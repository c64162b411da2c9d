"""Views of the star schema and the event stream as races: one row per runner, race card or record version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_rank(df: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("race_id").orderBy(F.desc(value), "post_no")
    return df.withColumn("finish_rank", F.row_number().over(w).cast("long"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runner frame from lineitem: a race is an order."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    joined = (
        line.withColumn("post_no", F.row_number().over(order).cast("long"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    date = F.col("o_orderdate").cast("date")
    shaped = joined.select(
        F.col("l_orderkey").alias("race_id"),
        date.alias("race_date"),
        F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        "post_no",
        F.col("l_partkey").alias("horse_id"),
        F.col("l_suppkey").alias("jockey_id"),
        F.col("s_nationkey").cast("long").alias("trainer_id"),
        (1 + F.col("l_quantity") / 10).alias("win_odds"),
        (F.col("p_size") * 100).cast("long").alias("distance"),
        F.col("l_returnflag").alias("surface"),
        F.col("l_linestatus").alias("going"),
        F.col("c_nationkey").cast("long").alias("venue"),
        F.col("o_orderpriority").alias("grade"),
        F.col("o_totalprice").alias("payout"),
        F.col("l_extendedprice").alias("price"),
    )
    # dealt by race once: queries that read the frame twice share this exchange
    return _with_rank(shaped.repartition("race_id"), "price")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Race cards of twelve runners from the event stream."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    race = F.floor(F.col("event_id") / 12).cast("long")
    shaped = e.select(race.alias("race_id"), (F.col("event_id") % 12 + 1).alias("post_no"), F.col("user_id").alias("horse_id"), "ts", "event_type", "value")
    w = Window.partitionBy("race_id")
    shaped = shaped.withColumn("start_ts", F.min("ts").over(w)).withColumn("surface", F.min_by("event_type", "post_no").over(w))
    return _with_rank(shaped.withColumn("win_odds", 1 + F.abs("value") / 10), "value")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record versions: key, state ("0" deletes), date made and arrival number."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return line.select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_quantity").cast("long") % 8).cast("string").alias("state"),
        F.col("l_shipdate").alias("made"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_extendedprice").alias("value"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record fields as the texts that a feed delivers them in, some of them missing or unreadable."""
    q = F.col("l_quantity").cast("long")
    text = lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(text(c), n, "0")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        q.alias("q"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("made"),
        F.when(q % 11 == 0, "   ").when(q % 13 == 0, "x1").otherwise(pad(F.col("l_partkey") % 1000, 3)).alias("size"),
        F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("sign"),
        pad((F.col("l_partkey") * 37) % 3000, 4).alias("time"),
        F.when(q % 17 == 0, "late").otherwise(text((F.col("l_partkey") % 24) * 100 + F.col("l_suppkey") % 60)).alias("hhmm"),
        pad(F.col("l_suppkey") % 62, 2).alias("track"),
        F.element_at(F.array(*(F.lit(x) for x in ("000", "005", "010", "016", "701", "703", "999", "", " x"))), (F.col("l_partkey") % 9 + 1).cast("int")).alias("entry"),
        F.element_at(F.array(*(F.lit(x) for x in ("003", "", "702", "100"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("entry2"),
        F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H,L, "), ","), (F.col("l_partkey") % 10 + 1).cast("int")).alias("grade_code"),
        F.concat(F.lit(" "), text(F.col("l_partkey")), F.when(q % 2 == 0, ".0").otherwise("")).alias("id"),
    )


RUNS = """
runs AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, post_no) AS finish_rank FROM (
    SELECT l_orderkey AS race_id, CAST(o_orderdate AS DATE) AS race_date, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS post_no,
      l_partkey AS horse_id, l_suppkey AS jockey_id, CAST(s_nationkey AS BIGINT) AS trainer_id, 1 + l_quantity / 10 AS win_odds,
      CAST(p_size * 100 AS BIGINT) AS distance, l_returnflag AS surface, l_linestatus AS going, CAST(c_nationkey AS BIGINT) AS venue,
      o_orderpriority AS grade, o_totalprice AS payout, l_extendedprice AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey))
"""
CARDS = """
cards AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY value DESC, post_no) AS finish_rank FROM (
    SELECT event_id // 12 AS race_id, event_id % 12 + 1 AS post_no, user_id AS horse_id, ts, event_type, value,
      min(ts) OVER (PARTITION BY event_id // 12) AS start_ts, 1 + abs(value) / 10 AS win_odds,
      first_value(event_type) OVER (PARTITION BY event_id // 12 ORDER BY event_id) AS surface
    FROM events))
"""
VERSIONS = """
versions AS (
  SELECT l_orderkey AS race_id, CAST(l_linenumber AS BIGINT) AS line, CAST(CAST(l_quantity AS BIGINT) % 8 AS VARCHAR) AS state, l_shipdate AS made,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
    l_extendedprice AS value FROM lineitem)
"""
FIELDS = """
fields AS (
  SELECT l_orderkey AS race_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS made,
    CASE WHEN CAST(l_quantity AS BIGINT) % 11 = 0 THEN '   ' WHEN CAST(l_quantity AS BIGINT) % 13 = 0 THEN 'x1' ELSE lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') END AS size,
    ['+', '-', ' '][l_suppkey % 3 + 1] AS sign, lpad(CAST((l_partkey * 37) % 3000 AS VARCHAR), 4, '0') AS time,
    CASE WHEN CAST(l_quantity AS BIGINT) % 17 = 0 THEN 'late' ELSE CAST((l_partkey % 24) * 100 + l_suppkey % 60 AS VARCHAR) END AS hhmm, lpad(CAST(l_suppkey % 62 AS VARCHAR), 2, '0') AS track,
    ['000', '005', '010', '016', '701', '703', '999', '', ' x'][l_partkey % 9 + 1] AS entry, ['003', '', '702', '100'][l_suppkey % 4 + 1] AS entry2,
    ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'L', ' '][l_partkey % 10 + 1] AS grade_code, ' ' || l_partkey || CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN '.0' ELSE '' END AS id
  FROM lineitem)
"""
