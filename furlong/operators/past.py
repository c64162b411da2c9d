"""Aggregates over the past of an entity that never see the row's own result.

``as_of`` says what the past is: "row" all earlier rows, "race" all rows of earlier races, "day" all rows of earlier
days. Totals are built from a table of the entity's days, so an entity with a large share of all rows is spread over its
days and no task gets all of its rows; what is earlier on the same day is added within (entity, day).

Rows with a null key have no past.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.session import TASK_ROWS

START = Window.unboundedPreceding


def day_totals(df: DataFrame, keys: list[str], sums: dict[str, Column], order: tuple[str, ...] = ("race_id", "post_no"), last: tuple[str, int, Column] | None = None) -> DataFrame:
    """keys, day, and the named sums over all earlier days of each day that an entity has; null values add nothing.

    last: name of an array, number of rows and value: structs whose field v has the values of so many last rows, the latest
    first. They are taken from the last rows of each day and handed on from day to day.
    """
    valued = df.withColumns({f"_v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()})
    totals = [F.sum(f"_v_{n}").alias(f"_d_{n}") for n in sums]
    w = Window.partitionBy(*keys).orderBy("day")
    carried = [F.coalesce(F.sum(f"_d_{n}").over(w.rowsBetween(START, -1)), F.lit(0.0)).alias(n) for n in sums]
    if last:
        name, k, value = last
        # only the day's last k rows are collected
        recent = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(*[F.desc(c) for c in order])) <= k
        valued = valued.withColumn("_late", F.when(recent, F.struct(*order, value.alias("v"))))
        totals.append(F.reverse(F.array_sort(F.collect_list("_late"))).alias("_days"))
        carried.append(F.slice(F.flatten(F.reverse(F.collect_list("_days").over(w.rowsBetween(-k, -1)))), 1, k).alias(name))
    return valued.groupBy(*keys, "day").agg(*totals or [F.count("*").alias("_d")]).select(*keys, "day", *carried)


def past_totals(df: DataFrame, keys: list[str], sums: dict[str, Column], as_of: str = "day", order: tuple[str, ...] = ("race_id", "post_no"), last: tuple[str, int, Column] | None = None, base: DataFrame | None = None, of_last: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with the sums of each named column over the past; null values add nothing.

    last: name of an array, number of rows and value: the values of so many last rows, the latest first. base: the rows that
    the days are made of, where df is one of several joins to the same rows: without it each of these would be made twice.
    of_last: named columns made of that array, which is then left out. As of the day before they are made in the table of
    days, so that no array goes through the join with the rows.
    """
    names = list(sums)
    days = day_totals(df if base is None else base, keys, sums, order, last)
    if last and as_of == "day":
        name = last[0]
        values = F.transform(name, lambda x: x["v"])
        if of_last:
            days = days.withColumn(name, values)
            days = days.withColumns({c: f(F.col(name)) for c, f in of_last.items()}).drop(name)
        else:
            days = days.withColumn(name, values)
    joined = df
    if as_of != "day":
        joined = df.withColumns({f"_v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()})
    if last and as_of == "row":
        joined = joined.withColumn("_now", F.struct(*order, last[2].alias("v")))
    out = joined.join(days, [*keys, "day"], "left").withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
    near = Window.partitionBy(*keys, "day")
    near = near.orderBy(*order).rowsBetween(START, -1) if as_of == "row" else near.orderBy("race_id").rangeBetween(START, -1)
    if as_of != "day":
        out = out.withColumns({n: F.col(n) + F.coalesce(F.sum(f"_v_{n}").over(near), F.lit(0.0)) for n in names})
    if last and as_of != "day":
        name, k, _ = last
        if as_of == "row":
            today = F.reverse(F.collect_list("_now").over(Window.partitionBy(*keys, "day").orderBy(*order).rowsBetween(-k, -1)))
            out = out.withColumn(name, F.slice(F.concat(today, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType))), 1, k))
        out = out.withColumn(name, F.transform(name, lambda x: x["v"])).drop("_now")
        if of_last:
            out = out.withColumns({c: f(F.col(name)) for c, f in of_last.items()}).drop(name)
    return out.drop(*(f"_v_{n}" for n in names))


def many_rows(df: DataFrame, key: str, most: int | None = None) -> list:
    """The entities with more than ``most`` rows (by default what a task gets): too many for one task, and few, as each of them takes
    that many rows. This counts the rows at once."""
    return [r[key] for r in df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > (TASK_ROWS if most is None else most)).select(key).collect()]


def by_size(df: DataFrame, key: str, many: list, few: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``few`` of the rows of most entities, and ``spread`` of those that have ``many``."""
    if not many:
        return few(df)
    large = F.coalesce(F.col(key).isin(many), F.lit(False))
    return few(df.where(~large)).unionByName(spread(df.where(large)))


def own_past(df: DataFrame, keys: list[str], sums: dict[str, Column], last: tuple[str, int, Column] | None = None, order: tuple[str, ...] = ("race_id", "post_no"), as_of: str = "row", many: list | None = None) -> DataFrame:
    """past_totals as of the row or the day, for an entity that runs about once a day, as a horse does: its days are as many as its rows,
    so a table of days would spare nothing, and one window over its rows needs no join. Not for people or places.

    many: the entities (of the first key) whose rows do not fit a task, from ``many_rows``, which is asked if they are not given. They
    go by the table of days, so no task gets all of their rows."""
    many = many_rows(df, keys[0]) if many is None else many
    return by_size(df, keys[0], many, lambda x: _one_window(x, keys, sums, last, order, as_of), lambda x: past_totals(x, keys, sums, as_of, order, last))


def _one_window(df: DataFrame, keys: list[str], sums: dict[str, Column], last: tuple[str, int, Column] | None, order: tuple[str, ...], as_of: str) -> DataFrame:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy("day", *order)
    before = w.rowsBetween(START, -1)
    if as_of == "day":
        known = known & F.col("day").isNotNull()
        before = Window.partitionBy(*keys).orderBy("day").rangeBetween(START, -1)
    made = {n: F.when(known, F.coalesce(F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).over(before), F.lit(0.0))).otherwise(0.0) for n, c in sums.items()}
    if last:
        name, k, value = last
        earlier = F.reverse(F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(-k, -1)))
        if as_of == "day":
            # what the day's first row has before it; the rows are in this order already
            df = df.withColumn("_earlier", earlier)
            earlier = F.first("_earlier").over(Window.partitionBy(*keys, "day").orderBy(*order))
        made[name] = F.transform(F.slice(earlier, 1, F.when(known, k).otherwise(0)), lambda x: x["v"])
    return df.withColumns(made).drop("_earlier")


def mean_of(values: Column) -> Column:
    """Mean of the known values of an array; null without one."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))


def one() -> Column:
    return F.lit(1)


def past_count(df: DataFrame, keys: list[str], name: str, as_of: str = "row") -> DataFrame:
    return past_totals(df, keys, {name: one()}, as_of).withColumn(name, F.col(name).cast("long"))


def past_sum(df: DataFrame, keys: list[str], value: str, name: str, as_of: str = "row") -> DataFrame:
    return past_totals(df, keys, {name: F.col(value)}, as_of)


def past_rate(df: DataFrame, keys: list[str], value: Column, name: str, min_count: int = 1, as_of: str = "row", base: DataFrame | None = None) -> DataFrame:
    """Past sum by the number of all past rows; null below min_count."""
    out = past_totals(df, keys, {"_n": one(), "_s": value}, as_of, base=base)
    return out.withColumn(name, F.when(F.col("_n") >= min_count, F.col("_s") / F.col("_n"))).drop("_n", "_s")


def past_mean(df: DataFrame, keys: list[str], value: Column, name: str, min_count: int = 1, as_of: str = "day") -> DataFrame:
    """Mean of the past values that are known."""
    out = past_totals(df, keys, {"_n": value.isNotNull().cast("int"), "_s": value}, as_of)
    return out.withColumn(name, F.when(F.col("_n") >= min_count, F.col("_s") / F.col("_n"))).drop("_n", "_s")


def past_moments(df: DataFrame, keys: list[str], value: Column, as_of: str = "day", order: tuple[str, ...] = ("race_id", "post_no"), base: DataFrame | None = None) -> DataFrame:
    """df with _n, _mean and _var (population) of the known past values.

    A day has its count, mean and sum of squared deviations, by an aggregate that merges these. Days are put together around
    the key's mean over all days, which only keeps the numbers small and does not change the result, and what is earlier on
    the same day is merged in; so values that are large against their spread lose no digits.
    """
    valued = df.withColumn("_mv", value.cast("double"))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(START, -1)
    source = valued if base is None else base.withColumn("_mv", value.cast("double"))
    days = source.groupBy(*keys, "day").agg(F.count("_mv").alias("_dn"), F.avg("_mv").alias("_dm"), (F.var_pop("_mv") * F.count("_mv")).alias("_dq"))
    every = Window.partitionBy(*keys)
    days = days.withColumn("_a", F.sum(F.col("_dm") * F.col("_dn")).over(every) / F.sum("_dn").over(every))
    off = F.col("_dm") - F.col("_a")
    days = days.select(*keys, "day", F.coalesce(F.sum("_dn").over(w), F.lit(0)).alias("_n"), F.sum(F.col("_dn") * off).over(w).alias("_o"), F.sum(F.col("_dq") + F.col("_dn") * off * off).over(w).alias("_q"), "_a")
    shift = F.try_divide("_o", "_n")
    days = days.select(*keys, "day", "_n", (F.col("_a") + shift).alias("_mean"), F.greatest(F.col("_q") - F.col("_o") * shift, F.lit(0.0)).alias("_m2"))
    out = valued.join(days, [*keys, "day"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if as_of != "day":
        near = Window.partitionBy(*keys, "day")
        near = near.orderBy(*order).rowsBetween(START, -1) if as_of == "row" else near.orderBy("race_id").rangeBetween(START, -1)
        out = out.withColumns({"_tn": F.count("_mv").over(near), "_tm": F.avg("_mv").over(near), "_tq": F.var_pop("_mv").over(near)})
        n, t = F.col("_n"), F.col("_tn")
        gap = F.col("_tm") - F.col("_mean")
        mean = F.when(n == 0, F.col("_tm")).when(t == 0, F.col("_mean")).otherwise(F.col("_mean") + gap * t / (n + t))
        m2 = F.coalesce("_m2", F.lit(0.0)) + F.coalesce(F.col("_tq") * t, F.lit(0.0)) + F.coalesce(gap * gap * n * t / (n + t), F.lit(0.0))
        out = out.withColumns({"_mean": mean, "_m2": m2, "_n": n + t}).drop("_tn", "_tm", "_tq")
    return out.withColumn("_var", F.try_divide("_m2", "_n")).drop("_mv", "_m2")


def past_std(df: DataFrame, keys: list[str], value: Column, name: str, min_count: int = 2, as_of: str = "day") -> DataFrame:
    """Population standard deviation of the past values that are known."""
    out = past_moments(df, keys, value, as_of)
    return out.withColumn(name, F.when(F.col("_n") >= min_count, F.sqrt("_var"))).drop("_n", "_mean", "_var")


def past_conditional_mean(df: DataFrame, keys: list[str], value: Column, condition: Column, name: str, min_count: int = 1, as_of: str = "day") -> DataFrame:
    return past_mean(df, keys, F.when(condition, value), name, min_count, as_of)


def past_window_mean(df: DataFrame, keys: list[str], value: Column, name: str, window: int, as_of: str = "row") -> DataFrame:
    """Mean of the last rows before this one, or before this day, a null value counting as 0."""
    return past_totals(df, keys, {}, as_of, last=("_recent", window, F.coalesce(value.cast("double"), F.lit(0.0))), of_last={name: mean_of})


def past_window_known(df: DataFrame, keys: list[str], value: Column, name: str, window: int, as_of: str = "row") -> DataFrame:
    """Sum and number of the known values among the last rows, as name_sum and name_n."""
    out = past_totals(df, keys, {}, as_of, last=("_recent", window, value.cast("double")))
    known = F.filter("_recent", lambda x: x.isNotNull())
    return out.withColumns({f"{name}_sum": F.coalesce(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), f"{name}_n": F.coalesce(F.size(known), F.lit(0)).cast("long")}).drop("_recent")


def previous(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The last known value before this row. Only days with a known value hand one on."""
    order = ("race_id", "post_no")
    valued = df.withColumn("_v", value)
    days = valued.where("_v is not null").groupBy(*keys, "day").agg(F.max_by("_v", F.struct(*order)).alias("_day"))
    every = valued.select(*keys, "day").distinct().join(days, [*keys, "day"], "left")
    before = every.select(*keys, "day", F.last("_day", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(START, -1)).alias("_before"))
    near = Window.partitionBy(*keys, "day").orderBy(*order).rowsBetween(START, -1)
    return valued.join(before, [*keys, "day"], "left").withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(near), F.col("_before"))).drop("_v", "_before")


def standardized(df: DataFrame, keys: list[str], value: Column, name: str, min_count: int = 30) -> DataFrame:
    """Deviation of the race's value from the races of earlier days under the same conditions, in standard deviations."""
    out = past_moments(past_totals(df, keys, {"_rows": one()}, "day"), keys, F.coalesce(value, F.lit(0.0)), "day", base=df)
    std = F.sqrt("_var")
    z = F.when((F.col("_rows") >= min_count) & (std > 0), F.try_divide(value - F.col("_mean"), std))
    return out.withColumn(name, z).drop("_rows", "_n", "_mean", "_var")


def block_start(days: DataFrame) -> DataFrame:
    """For every day the first day of its run of consecutive days. The days of a calendar are few; one window orders them."""
    distinct = days.select("day").where("day is not null").distinct()
    island = F.col("day") - F.row_number().over(Window.orderBy("day"))
    return distinct.withColumn("_i", island).withColumn("block_start", F.min("day").over(Window.partitionBy("_i"))).drop("_i")


def substituted(df: DataFrame, keys: list[str], column: str, known: Column, target: Column) -> DataFrame:
    """value: on the target rows the last known earlier value in place of the own one, with no change; origin says which."""
    out = previous(df, keys, F.when(known, F.col(column)), "_earlier")
    origin = F.when(~target, "own").when(F.col("_earlier").isNotNull(), "previous").otherwise("none")
    return out.withColumns({"value": F.when(target, F.col("_earlier")).otherwise(F.col(column)), "change": F.when(target, 0).otherwise(F.col(column) - F.col("_earlier")).cast("long"), "origin": origin}).drop("_earlier")
