"""Conditional logit: the probability of a race's winner as the softmax of a few terms of its runners.

Each Newton step is one aggregate over all runners; the driver holds as many numbers as the Hessian has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.market import one_winner


@dataclass
class Fit:
    columns: list[str]
    beta: np.ndarray
    loglik: float


def _score(columns: list[str], beta: list[float] | np.ndarray) -> Column:
    z = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        z = z + F.coalesce(F.col(c), F.lit(0.0)) * float(b)
    return z


def probability(df: DataFrame, columns: list[str], beta: list[float] | np.ndarray, name: str) -> DataFrame:
    """The softmax of the terms within a race; a null term counts as 0."""
    w = Window.partitionBy("race_id")
    out = df.withColumn("_z", _score(columns, beta))
    out = out.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return out.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def terms(df: DataFrame, columns: list[str], beta: list[float] | np.ndarray) -> DataFrame:
    """races, loglik, gradient g0.. and Hessian h0_0.. of the races with exactly one winner, in one row."""
    q = probability(one_winner(df), columns, beta, "_q")
    won = (F.col("finish_rank") == 1).cast("double")
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    k = range(len(columns))
    race = q.groupBy("race_id").agg(F.sum(won * F.log("_q")).alias("l"), *(F.sum((won - F.col("_q")) * x[i]).alias(f"g{i}") for i in k), *(F.sum(F.col("_q") * x[i]).alias(f"m{i}") for i in k), *(F.sum(F.col("_q") * x[i] * x[j]).alias(f"s{i}_{j}") for i in k for j in k if j <= i))
    return race.agg(F.count("*").alias("races"), F.sum("l").alias("loglik"), *(F.sum(f"g{i}").alias(f"g{i}") for i in k), *(F.sum(F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"h{i}_{j}") for i in k for j in k if j <= i))


def fit(df: DataFrame, columns: list[str], rounds: int = 30, tol: float = 1e-8) -> Fit:
    """Newton's method with halved steps where the likelihood would fall. A term without variation keeps 0; without races
    with one winner all do."""
    n = len(columns)
    beta = np.zeros(n)
    # only what the steps read, dealt by race once and kept for all of them
    slim = df.select("race_id", "finish_rank", *columns).repartition("race_id").persist()

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        r = terms(slim, columns, b).first()
        g = np.array([r[f"g{i}"] or 0.0 for i in range(n)])
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        return (r["loglik"] or 0.0), g, h

    try:
        value, g, h = at(beta)
        for _ in range(rounds):
            step, scale = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
            while True:
                new = at(beta + scale * step)
                if new[0] >= value - 1e-9 * max(1.0, abs(value)) or scale < 1e-4:
                    break
                scale /= 2
            gain = new[0] - value
            beta, (value, g, h) = beta + scale * step, new
            if abs(gain) < tol * max(1.0, abs(value)):
                break
    finally:
        slim.unpersist()
    return Fit(columns, beta, value)


def walk_forward(df: DataFrame, columns: list[str], fold: str, name: str) -> DataFrame:
    """Each fold scored by a fit on the folds before it; the first has none. The folds are a design of a few."""
    folds = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    found = None
    for k in folds[1:]:
        part = probability(df.where(F.col(fold) == k), columns, fit(df.where(F.col(fold) < k), columns).beta, name)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else df.limit(0).withColumn(name, F.lit(None).cast("double"))
