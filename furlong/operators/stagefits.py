"""How the second and the third place follow from the probabilities of the first, fitted by fold on the folds before it.

A runner's strength for a place is p ** power * exp(lean * x), among the runners that are still in. ``fold_discounts`` takes
powers from a grid: likelihoods are added up for each fold once, and a window adds the earlier folds. ``fold_stages`` refines
power and lean by Newton steps; one aggregate has the gradients and Hessians of all folds and both places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.market import clean_races

#: Folds are a design of a few; every row is weighed once for each later fold.
MOST_FOLDS = 64
PLACES = (2, 3)


def fold_tables(df: DataFrame, p: str, grid: list[float], fold: str) -> DataFrame:
    """fold, power, races, second, third: the likelihoods of one fold's races."""
    clean = clean_races(df, p).withColumn("race_id", F.struct(fold, "race_id"))
    races = discount_grid_by(clean, p, grid)
    return races.groupBy(F.col("race_id")[fold].alias(fold), "power").agg(F.count("*").alias("races"), F.sum("second").alias("second"), F.sum("third").alias("third"))


def discount_grid_by(df: DataFrame, p: str, grid: list[float]) -> DataFrame:
    """race_id, power, second, third: the log-likelihoods of every race."""
    each = df.select("race_id", "finish_rank", p, F.explode(F.array(*(F.lit(float(g)) for g in grid))).alias("power")).withColumn("v", F.pow(p, "power"))
    races = each.groupBy("race_id", "power").agg(F.sum("v").alias("s"), *(F.max(F.when(F.col("finish_rank") == k, F.col("v"))).alias(f"v{k}") for k in (1, 2, 3)))
    second, third = F.log("v2") - F.log(F.col("s") - F.col("v1")), F.log("v3") - F.log(F.col("s") - F.col("v1") - F.col("v2"))
    return races.select("race_id", "power", second.alias("second"), third.alias("third"))


def fold_discounts(df: DataFrame, p: str, grid: list[float], fold: str = "fold") -> DataFrame:
    """fold, races, gamma, delta: the grid's powers that fit the second and third places of all earlier folds best; of equal
    ones the least. A fold without earlier races is left out."""
    table = fold_tables(df, p, grid, fold)
    w = Window.partitionBy("power").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    past = table.select(fold, "power", *(F.sum(c).over(w).alias(c) for c in ("races", "second", "third"))).where("races > 0")
    best = lambda c: F.max_by("power", F.struct(F.round(c, 9), -F.col("power")))
    return past.groupBy(fold).agg(F.max("races").alias("races"), best("second").alias("gamma"), best("third").alias("delta"))


def _newton_terms(slim: DataFrame, fold: str, betas: dict[tuple, np.ndarray], k: int) -> dict[tuple, tuple[int, float, np.ndarray, np.ndarray]]:
    """For each (fold, place): races, likelihood, gradient and Hessian of the races of earlier folds."""
    tries = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(place).alias("place"), F.array(*(F.lit(float(b)) for b in beta)).alias("b")) for (f, place), beta in betas.items()))
    each = slim.select("race_id", fold, "finish_rank", "x", F.explode(F.filter(tries, lambda t: t["f"] > F.col(fold))).alias("t"))
    # those that came in before the place are out
    each = each.where(F.col("finish_rank").isNull() | (F.col("finish_rank") >= F.col("t.place")) | (F.col("finish_rank") < 1))
    z = sum((F.col("x")[i] * F.col("t.b")[i] for i in range(k)), F.lit(0.0))
    e = F.exp(F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0)))
    chosen = F.col("finish_rank") == F.col("t.place")
    each = each.withColumns({"_e": e, "_z": z})
    x = [F.col("x")[i] for i in range(k)]
    race = each.groupBy("race_id", fold, "t.f", "t.place").agg(
        F.sum("_e").alias("s"),
        F.sum(F.when(chosen, F.col("_z"))).alias("z"),
        *(F.sum(F.when(chosen, x[i])).alias(f"c{i}") for i in range(k)),
        *(F.sum(F.col("_e") * x[i]).alias(f"m{i}") for i in range(k)),
        *(F.sum(F.col("_e") * x[i] * x[j]).alias(f"h{i}{j}") for i in range(k) for j in range(i + 1)),
    )
    mean = lambda c: F.col(c) / F.col("s")
    total = race.groupBy("f", "place").agg(
        F.count("*").alias("races"),
        F.sum(F.col("z") - F.log("s")).alias("loglik"),
        *(F.sum(F.col(f"c{i}") - mean(f"m{i}")).alias(f"g{i}") for i in range(k)),
        *(F.sum(mean(f"h{i}{j}") - mean(f"m{i}") * mean(f"m{j}")).alias(f"h{i}{j}") for i in range(k) for j in range(i + 1)),
    )
    out = {}
    for r in total.collect():  # a row for each fold and place
        h = np.array([[r[f"h{max(i, j)}{min(i, j)}"] for j in range(k)] for i in range(k)])
        out[r["f"], r["place"]] = (r["races"], r["loglik"], np.array([r[f"g{i}"] for i in range(k)]), h)
    return out


def fold_stages(df: DataFrame, p: str, lean: str | None = None, fold: str = "fold", rounds: int = 25, tol: float = 1e-9) -> DataFrame:
    """fold, races, gamma, phi, delta, psi: power and lean of the second and of the third place, by the races of all earlier
    folds. Without ``lean`` phi and psi are null. A missing lean counts as 0. A fold without earlier races is left out."""
    spark = df.sparkSession
    clean = clean_races(df, p).where(F.col(fold).isNotNull())
    share = F.log(F.col(p) / F.sum(p).over(Window.partitionBy("race_id")))
    terms = [share, *([F.coalesce(F.col(lean).cast("double"), F.lit(0.0))] if lean else [])]
    k = len(terms)
    slim = clean.select("race_id", fold, "finish_rank", F.array(*terms).alias("x")).repartition("race_id").persist()
    try:
        folds = sorted(r[0] for r in slim.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
        if len(folds) > MOST_FOLDS:
            raise ValueError(f"more than {MOST_FOLDS} folds")
        betas = {(f, place): np.zeros(k) for f in folds[1:] for place in PLACES}
        now = _newton_terms(slim, fold, betas, k) if betas else {}
        scale, open_ = dict.fromkeys(betas, 1.0), set(now)
        for _ in range(rounds):
            if not open_:
                break
            steps = {c: np.linalg.lstsq(now[c][3], now[c][2], rcond=None)[0] for c in open_}
            tried = {c: betas[c] + scale[c] * steps[c] for c in open_}
            new = _newton_terms(slim, fold, tried, k)
            for c in list(open_):
                gain = new[c][1] - now[c][1]
                if gain >= -tol * max(1.0, abs(now[c][1])):
                    betas[c], now[c], scale[c] = tried[c], new[c], 1.0
                    if gain < tol * max(1.0, abs(now[c][1])):
                        open_.discard(c)
                else:
                    scale[c] /= 2
        rows = []
        for f in folds[1:]:
            second, third = betas[f, 2], betas[f, 3]
            rows.append((f, now[f, 2][0], *(float(v) if v is not None else None for v in (second[0], second[1] if lean else None, third[0], third[1] if lean else None))))
    finally:
        slim.unpersist()
    kind = df.schema[fold].dataType.simpleString()
    return spark.createDataFrame(rows, f"{fold} {kind}, races long, gamma double, phi double, delta double, psi double")
