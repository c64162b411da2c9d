"""From records to tables: typing, choosing versions, joining and comparing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns that hold the result of a race, and states of records.
RESULTS = ("finish_rank", "price")
FINAL_STATES, ENTRY_STATES = ("5", "6", "7"), ("1", "2")
CENTRAL = tuple(f"{k:02d}" for k in range(1, 11))


def money(text: Column) -> Column:
    """"1,230円" is 1230; texts without a number are missing."""
    return F.regexp_replace(text, "[,円 ]", "").try_cast("double")


def payout_column(columns: list[str], kind: str) -> str | None:
    """The column that holds the payouts of a kind of bet: one that says payout, else odds, else the first that names the kind."""
    named = [c for c in columns if kind in c.lower()]
    for word in ("payout", "odds"):
        for c in named:
            if re.search(word, c, re.IGNORECASE):
                return c
    return named[0] if named else None


def typed_runs(df: DataFrame, numbers: list[str], results: bool = True) -> DataFrame:
    """Named texts as numbers, a change of 0 where it is missing, and won. With ``results`` only runners with a rank and a time."""
    out = df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in numbers}).withColumn("change", F.coalesce("change", F.lit(0.0)))
    if results:
        out = out.where("rank is not null and seconds is not null")
    return out.withColumns({"rank": F.col("rank").cast("long"), "won": (F.col("rank") == 1).cast("long")})


def split_at(df: DataFrame, day: str, share: float) -> DataFrame:
    """part: "train" for the days up to the quantile of all rows' days, "test" after it."""
    from furlong.operators.stats import quantiles

    edge = quantiles(df, [], day, [share], "_e").select(F.col("_e")[0].alias("_e"))
    return df.join(F.broadcast(edge)).withColumn("part", F.when(F.col(day) <= F.col("_e"), "train").otherwise("test")).drop("_e")


def years_between(df: DataFrame, date: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the years from first to last, both included; an end that is not given is open."""
    return df.where((F.year(date) >= first if first is not None else F.lit(True)) & (F.year(date) <= last if last is not None else F.lit(True)))


def central_only(df: DataFrame, venue: str, state: str) -> DataFrame:
    """Records of the central venues that are not foreign or local ones by their state."""
    return df.where(F.col(venue).isin(*CENTRAL) & ~F.coalesce(F.col(state).isin("A", "B"), F.lit(False)))


def best_versions(df: DataFrame, keys: list[str], confirmed: Column, priority: Column, order: tuple[str, ...] = ("made", "seq")) -> DataFrame:
    """One row per key: confirmed before others, then by date made, priority and arrival, the last; n_versions counts them."""
    made, *rest = order
    rest_ = [c for c in df.columns if c not in keys]
    place = F.struct(F.coalesce(confirmed, F.lit(False)).alias("c"), F.col(made).alias("m"), F.coalesce(priority, F.lit(-1)).alias("p"), *(F.col(c) for c in rest))
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest_), place).alias("_s"), F.count("*").alias("n_versions"))
    return top.select(*keys, "_s.*", "n_versions")


def odds_versions(df: DataFrame, priority: Column, final_only: bool = False) -> DataFrame:
    """For each race and kind the snapshot of the highest state, made last, from the last file; final_only: of states 4 and 5."""
    kept = df.where(F.col("state").isin("4", "5")) if final_only else df
    return best_versions(kept.withColumn("_p", priority), ["race_id", "kind"], F.lit(True), F.lit(0), ("_p", "made", "seq")).drop("_p")


def going(surface: Column, turf: Column, dirt: Column) -> Column:
    """The going of the race's surface; the dirt's where that is missing."""
    return F.coalesce(F.when(surface == "dirt", dirt).otherwise(turf), dirt)


def with_origin(official: Column, derived: Column) -> tuple[Column, Column]:
    """The official value, else the derived one, and where it is from."""
    return F.coalesce(official, derived), F.when(official.isNotNull(), "official").when(derived.isNotNull(), "laps").otherwise("none")


def final_runners(runners: DataFrame, races: DataFrame, abnormal: str) -> DataFrame:
    """Runners of known races that ran to the end: no abnormal code 1 to 5, and a rank."""
    return runners.join(races, "race_id").where(~F.coalesce(F.col(abnormal).isin("1", "2", "3", "4", "5"), F.lit(False)) & F.col("finish_rank").isNotNull())


def entries(runners: DataFrame, races: DataFrame, abnormal: str) -> DataFrame:
    """Runners of coming races that are not scratched, when the race's records were last made, and whether all posts are drawn."""
    w = Window.partitionBy("race_id")
    own = runners.where(F.col("state").isin(*ENTRY_STATES)).join(races, "race_id").where(~F.coalesce(F.col(abnormal).isin("1", "2", "3"), F.lit(False)))
    return own.withColumns({"made_last": F.max("made").over(w), "drawn": F.min(F.col("post_no").isNotNull().cast("int")).over(w) == 1})


def payout_lists(slots: Column) -> Column:
    """Of an array of (combination, payout) texts: the first payout, the number of winning combinations, and all of both."""
    good = F.filter(F.transform(slots, lambda x: F.struct(F.trim(x["combination"]).alias("combination"), money(x["payout"]).alias("payout"))), lambda x: x["combination"].rlike("^[0-9]+$") & ~x["combination"].isin("0000", "000000") & (x["payout"] > 0))
    return F.struct(
        F.get(good, F.lit(0))["payout"].alias("payout"),
        F.size(good).cast("long").alias("n_hits"),
        F.array_join(F.transform(good, lambda x: x["combination"]), ";").alias("combinations"),
        F.array_join(F.transform(good, lambda x: x["payout"].cast("long").cast("string")), ";").alias("payouts"),
    )


def no_payout_reason(first: Column, void: Column) -> Column:
    """Why a race has no payout: nothing sold, or void."""
    none = F.coalesce(F.trim(first).isin("", "000000"), F.lit(True))
    return F.when(none & void, "void").when(none, "not sold").otherwise("")


def both_ways(races: DataFrame, runners: DataFrame, key: str = "race_id") -> tuple[DataFrame, DataFrame]:
    """Races that have runners, and runners that have a race."""
    return races.join(runners.select(key).distinct(), key, "left_semi"), runners.join(races.select(key).distinct(), key, "left_semi")


def blank_results(df: DataFrame) -> DataFrame:
    """The rows with all results of the race set to null."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in RESULTS if c in df.columns})


def require_none(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """df, or an error if any row meets the condition."""
    if not df.where(condition).isEmpty():
        raise ValueError(f"{what}: rows that must not be here")
    return df


def choose_predictions(preds: DataFrame, schedule: DataFrame) -> DataFrame:
    """For each kind and race the file to compare: of live ones the last made before the start, of practice ones the last whose
    model had not seen the race, else the last. Races of live files made too late have a null file."""
    timed = preds.join(schedule, "race_id", "left")
    live = F.col("kind") == "live"
    usable = ~live | F.col("start").isNull() | (F.col("made") < F.col("start"))
    unseen = F.when(live, 0).otherwise(F.coalesce((F.col("trained_until") < F.col("day")).cast("int"), F.lit(0)))
    return timed.groupBy("kind", "race_id").agg(F.max_by(F.when(usable, F.col("file")), F.when(usable, F.struct(unseen, "made", "file"))).alias("file"), F.count_distinct("file").alias("files"))


def append_widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows with all columns of both; what a table lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of all old ones with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], relative: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """For each column: rows compared, rows that differ beyond the tolerances (nulls are equal), and keys of one table alone."""
    right = b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(1).alias("_in_b"))
    both = a.select(*keys, *columns, F.lit(1).alias("_in_a")).join(right, keys, "full")
    matched = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    same = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"_b_{c}")) <= absolute + relative * F.abs(F.col(f"_b_{c}")), F.col(c).isNull() & F.col(f"_b_{c}").isNull())
    one = F.sum((~matched).cast("long")).alias("alone")
    wide = both.agg(F.sum(matched.cast("long")).alias("n"), one, *(F.sum((matched & ~same(c)).cast("long")).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), F.col(c).alias("different"), F.col("alone")) for c in columns))).alias("r")).select("r.*")


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """rows of each table, keys of both, and whether each key stands as often in one as in the other."""
    counts = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys, "full").fillna(0, ["_a", "_b"])
    return counts.agg(F.sum("_a").alias("rows_a"), F.sum("_b").alias("rows_b"), F.sum(((F.col("_a") > 0) & (F.col("_b") > 0)).cast("long")).alias("shared"), (F.sum((F.col("_a") != F.col("_b")).cast("long")) == 0).alias("aligned"))


def gaps(df: DataFrame, by: list[str], at: str, limit: int) -> DataFrame:
    """Rows that come at least ``limit`` after the one before them in their group, with the gap."""
    w = Window.partitionBy(*by).orderBy(at)
    return df.withColumn("gap", F.col(at) - F.lag(at).over(w)).where(F.col("gap") >= limit)


def first_seen(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """When each key came first."""
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen"))


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys by a hash of key and seed: the same ones on every run, whatever the partitions."""
    keys = df.select(key).distinct()
    return df.join(keys.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n), key, "left_semi")
