"""Exact quantiles without one task for a group, intervals and tests of proportions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.session import materialize

START = Window.unboundedPreceding


def ranked_counts(df: DataFrame, by: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """by, value, n and the named aggregates, and ``before``: how many rows of the group have a smaller value.

    Values are counted first, then dealt by ranges; a group is spread over as many ranges as it needs. The ranges are
    written once, so that all that reads them sees the same ones.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (extra or {}).items()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(spark, counts.repartitionByRange(parts, *by, value).withColumn("part", F.spark_partition_id()), "ranged")
    # a row for each group and range
    totals = ranged.groupBy(*by, "part").agg(F.sum("n").alias("_m"))
    base = totals.select(*by, "part", F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("part").rowsBetween(START, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "part").orderBy(value).rowsBetween(START, -1)), F.lit(0))
    joined = ranged.withColumn("_in", inside).alias("r").join(base.alias("b"), (F.col("r.part") == F.col("b.part")) & _all_same(by))
    return joined.select(*(F.col(f"r.{c}") for c in (*by, value, "n", *(extra or {}))), (F.col("b._base") + F.col("r._in")).alias("before"))


def _all_same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """by, n and an array of the exact quantiles (linear between two values) of the known values."""
    ranked = ranked_counts(df.withColumn("_x", F.col(value).cast("double")), by, "_x")
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("size"))
    both = ranked.alias("r").join(sizes.alias("b"), _all_same(by)) if by else ranked.alias("r").crossJoin(F.broadcast(sizes).alias("b"))
    own, first, last = F.col("r._x"), F.col("r.before"), F.col("r.before") + F.col("r.n") - 1
    picks = []
    for k, q in enumerate(shares):
        at = F.lit(q) * (F.col("b.size") - 1)
        low = F.floor(at)
        covers = lambda p: (first <= p) & (last >= p)
        picks.append((F.max(F.when(covers(low), own)), F.max(F.when(covers(F.ceil(at)), own)), F.first(at - low), k))
    found = both.groupBy(*(F.col(f"r.{c}").alias(c) for c in by), F.col("b.size").alias("n")).agg(*(x.alias(f"_{w}{k}") for lo, hi, f, k in picks for w, x in (("l", lo), ("h", hi), ("f", f))))
    values = [F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}") for k in range(len(shares))]
    return found.select(*by, "n", F.array(*values).alias(name))


def normal_interval(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits, n)
    e = z * F.sqrt(p * (1 - p) / n)
    return p - e, p + e


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits, n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def normal_tail(z: Column, terms: int = 160) -> Column:
    """Two-sided probability beyond z, by the series of the normal distribution; 0 beyond 8 deviations."""
    x = F.abs(z)
    start = F.struct(x.alias("t"), x.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    return F.when(x > 8, 0.0).otherwise(F.greatest(1 - 2 * series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi), F.lit(0.0)))


def two_proportions(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> dict[str, Column]:
    """Difference of two independent proportions: z by the pooled share, its p, and Newcombe's bounds. Null if a side is empty."""
    a, b = F.try_divide(hits_a, n_a), F.try_divide(hits_b, n_b)
    pooled = F.try_divide(hits_a + hits_b, n_a + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    z = F.when(error > 0, (a - b) / error).when(error == 0, 0.0)
    (la, ua), (lb, ub) = wilson(hits_a, n_a), wilson(hits_b, n_b)
    sq = lambda x: x * x
    return {"difference": a - b, "z": z, "p_value": normal_tail(z), "low": a - b - F.sqrt(sq(a - la) + sq(ub - b)), "high": a - b + F.sqrt(sq(ua - a) + sq(b - lb))}


def sign_test(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test of b against c successes of equal chance."""
    m, k = (b + c).cast("double"), F.least(b, c)
    begin = F.struct(F.lit(0.0).alias("log"), F.exp(-m * math.log(2)).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.log((m - i + 1) / i)).alias("log"), (a["sum"] + F.exp(a["log"] + F.log((m - i + 1) / i) - m * math.log(2))).alias("sum"))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), begin, step, lambda a: a["sum"])).otherwise(F.exp(-m * math.log(2)))
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_proportions(both: Column, only_x: Column, only_y: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """Difference of two proportions on the same rows: bounds from both Wilson intervals and the correlation of the
    two, with continuity correction, and the exact test of the rows on which they differ."""
    a, b, c, m = (x.cast("double") for x in (both, only_x, only_y, n))
    d = m - a - b - c
    p, q = F.try_divide(a + b, m), F.try_divide(a + c, m)
    (l1, u1), (l2, u2) = wilson(a + b, m, z), wilson(a + c, m, z)
    scale, cross = F.sqrt((a + b) * (c + d) * (a + c) * (b + d)), a * d - b * c
    phi = F.when(scale == 0, 0.0).otherwise(F.when(cross > 0, F.greatest(cross - m / 2, F.lit(0.0))).otherwise(cross) / F.nullif(scale, F.lit(0.0)))
    half = lambda x, y: F.sqrt(F.greatest(x * x - 2 * phi * x * y + y * y, F.lit(0.0)))
    return {"difference": p - q, "low": p - q - half(p - l1, u2 - q), "high": p - q + half(u1 - p, q - l2), "p_value": sign_test(only_x, only_y)}
