"""Positions in the running: passing orders, running styles from the past, and what a field's styles say of its pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators import past

# Upper ends of the styles' bands of the mean relative position.
STYLES = (("front", 0.10), ("stalker", 0.35), ("mid", 0.70), ("closer", None))


def passing_order(text: Column) -> Column:
    """Post numbers and ranks of a passing order such as "(*13,6)4,10-2": those in brackets share a rank, the next rank
    counts all before it, and of a number that comes twice the first place holds. A bracket may lack its end; one that
    begins before the last one has ended takes the earlier one's place. Null and unreadable texts give none."""
    return _ranked(_kept(_tokens(text)))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[()]|[0-9]+"), F.lit(0))


def _kept(tokens: Column) -> Column:
    """The numbers that count, each with its place and the place where its bracket begins."""

    def place(t: Column, i: Column) -> Column:
        before = F.reverse(F.slice(tokens, F.lit(1), i))
        opened, closed = F.array_position(before, "("), F.array_position(before, ")")
        inside = (opened > 0) & ((closed == 0) | (opened < closed))
        after = F.get(F.filter(F.slice(tokens, i + 2, F.size(tokens)), lambda x: x.isin("(", ")")), F.lit(0))
        begin = F.when(inside, i - opened.cast("int")).otherwise(i)
        return F.struct(t.try_cast("int").alias("post_no"), i.alias("i"), begin.alias("begin"), (inside & F.coalesce(after == "(", F.lit(False))).alias("lost"))

    return F.filter(F.transform(tokens, place), lambda x: x["post_no"].isNotNull() & ~x["lost"])


def _ranked(kept: Column) -> Column:
    first = F.filter(kept, lambda x: ~F.exists(kept, lambda y: (y["post_no"] == x["post_no"]) & (y["i"] < x["i"])))
    return F.transform(first, lambda x: F.struct(x["post_no"].alias("post_no"), (F.size(F.filter(kept, lambda y: y["i"] < x["begin"])) + 1).alias("rank")))


def corner_ranks(orders: DataFrame, key: str, corners: list[str]) -> DataFrame:
    """key, corner, post_no, rank of every runner in the named columns of passing orders. Tokens and kept numbers are columns
    of their own: inside of lambdas they would be made again for each token."""
    each = F.array(*(F.struct(F.lit(k + 1).alias("corner"), F.col(c).alias("text")) for k, c in enumerate(corners)))
    # texts are dealt out: a table of few row groups would be read by as few tasks
    long = orders.select(key, *corners).repartition(key).select(key, F.explode(each).alias("c")).select(key, "c.corner", _tokens(F.col("c.text")).alias("tokens"))
    kept = long.select(key, "corner", _kept(F.col("tokens")).alias("kept"))
    return kept.select(key, "corner", F.explode(_ranked(F.col("kept"))).alias("o")).select(key, "corner", "o.post_no", "o.rank")


def relative(rank: Column, field: Column) -> Column:
    """Position between 0 (first) and 1 (last); null in a field of one and for a rank of 0."""
    return F.when((rank > 0) & (field > 1), F.least(F.greatest(F.try_divide(rank - 1, field - 1), F.lit(0.0)), F.lit(1.0)))


def style_of(score: Column) -> Column:
    score, out = F.round(score, 9), None
    for name, top in STYLES[:-1]:
        out = F.when(score < top, name) if out is None else out.when(score < top, name)
    return out.when(score.isNotNull(), STYLES[-1][0])


def running_style(df: DataFrame, position: str) -> DataFrame:
    """Mean, deviation and number of a horse's earlier positions, mean of the last three, the last one, the mean when it
    was placed, and the style."""
    p = F.col(position)
    known = p.isNotNull().cast("int")
    shown = F.col("finish_rank") <= 3
    sums = {"_n": known, "_s": p, "_q": p * p, "_pn": F.when(shown, known), "_ps": F.when(shown, p)}
    out = past.past_totals(df, ["horse_id"], sums, "row", last=("_last", 3, p.cast("double")))
    n = F.col("_n")
    variance = F.greatest(F.try_divide("_q", "_n") - F.pow(F.try_divide("_s", "_n"), F.lit(2)), F.lit(0.0))
    out = out.withColumns({
        "style": F.when(n > 0, F.col("_s") / n),
        "style_spread": F.when(n >= 2, F.sqrt(variance)),
        "style_n": n.cast("long"),
        "style_last3": past.mean_of(F.col("_last")),
        "style_previous": F.get("_last", F.lit(0)),
        "style_placed": F.when(F.col("_pn") > 0, F.col("_ps") / F.col("_pn")),
    })
    return out.withColumn("style_name", style_of(F.col("style"))).drop(*sums, "_last")


def official_style(df: DataFrame, code: str) -> DataFrame:
    """From an official style 1 to 4 of each start: past mean, shares of 1 and 4, the last one, and the gap to the field."""
    c = F.when(F.col(code).between(1, 4), F.col(code))
    sums = {"_n": c.isNotNull().cast("int"), "_s": c, "_one": (c == 1).cast("int"), "_four": (c == 4).cast("int")}
    out = past.past_totals(df, ["horse_id"], sums, "row", last=("_last", 1, c.cast("long")))
    n = F.col("_n")
    out = out.withColumns({"official_mean": F.when(n > 0, F.col("_s") / n), "official_front": F.when(n > 0, F.col("_one") / n), "official_closing": F.when(n > 0, F.col("_four") / n), "official_previous": F.get("_last", F.lit(0))})
    gap = F.col("official_mean") - F.avg("official_mean").over(Window.partitionBy("race_id"))
    return out.withColumn("official_gap", gap).drop(*sums, "_last")


def pace_scenario(df: DataFrame) -> DataFrame:
    """What the styles of a field say: how many want to lead, own place among them, pressure, and where the own post is."""
    w = Window.partitionBy("race_id")
    front = F.coalesce((F.col("style_name") == "front").cast("int"), F.lit(0))
    near = F.coalesce((F.col("style_name") == "stalker").cast("int"), F.lit(0))
    out = df.withColumns({
        "fronts": F.sum(front).over(w),
        "stalkers": F.sum(near).over(w),
        "style_rank": F.when(F.col("style").isNotNull(), F.rank().over(w.orderBy(F.asc_nulls_last(F.round("style", 9)))).cast("long")),
        "style_gap": F.col("style") - F.avg("style").over(w),
        "pressure": (F.sum(front).over(w) + 0.5 * F.sum(near).over(w)) / F.count("*").over(w),
        "post": F.try_divide(F.col("post_no") - 1, F.max("post_no").over(w) - 1),
    })
    return out.withColumns({
        "lone_front": ((F.col("fronts") == 1) & (F.col("style_name") == "front")).cast("long"),
        "post_style": F.col("post") * F.col("style"),
        "inside_front": (1 - F.col("post")) * (1 - F.col("style")),
        "distance_style": F.col("distance") / 1000 * F.col("style"),
    }).withColumn("lone_front", F.coalesce("lone_front", F.lit(0)).cast("long"))
