"""Formation cards: the first a, b and c runners by probability in the columns of the first, second and third place.

A card is a box of the first a * b * c cells of a race's cube of ordered triples. Sums over all boxes are prefix sums of the
cube along its three sides; a race's cube has at most ``size`` ** 3 cells and is one value of its row, so races need nothing of
each other. Cards are chosen one after the other: the box whose cells that are not covered yet add the most hot probability for
each of its points. A cell is hot if a bet on it would pay the target by its fair share of the pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.codes import PAYOUT_RATE
from furlong.session import prepare

FIRST_MOST, SECOND_MOST = 3, 6
UNIT = 100
CARDS = "race_id {}, card long, a long, b long, c long, points long, gain double"


def place(p: str) -> Column:
    return F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc(F.round(p, 12)), "post_no"))


def tensor_cells(tensor: DataFrame, order: DataFrame, p: str, size: int) -> DataFrame:
    """race_id, cells (a, b, c, prob; places in the order by p from 0) of all triples among the first ``size``."""
    top = order.withColumn("_k", place(p)).where(F.col("_k") <= size)
    places = top.groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct("post_no", F.col("_k") - 1))).alias("at"))  # at most ``size``
    # one row of each race meets its triples, which are not sorted for it
    cells = tensor.join(places.hint("shuffle_hash"), "race_id").select("race_id", *(F.col("at")[F.col(x)].alias(y) for x, y in (("i", "a"), ("j", "b"), ("k", "c"))), "prob")
    return cells.where("a is not null and b is not null and c is not null").groupBy("race_id").agg(F.collect_list(F.struct("a", "b", "c", "prob")).alias("cells"))


def order_cells(races: DataFrame, size: int) -> DataFrame:
    """The same from a row for each race (``market.strengths``) whose runners are in the order by p."""
    r = F.slice("r", 1, size)
    spot = lambda x, a: F.struct(a.alias("at"), x["a"].alias("a"), x["g"].alias("g"), x["d"].alias("d"))
    top = races.select("race_id", "sg", "sd", F.transform(r, spot).alias("r"))

    def prob(x: Column, y: Column, z: Column) -> Column:
        return x["a"] * y["g"] / (F.col("sg") - x["g"]) * z["d"] / (F.col("sd") - x["d"] - y["d"])

    cell = lambda x, y, z: F.struct(x["at"].alias("a"), y["at"].alias("b"), z["at"].alias("c"), prob(x, y, z).alias("prob"))
    others = lambda *xs: F.filter("r", lambda z: ~z["at"].isin(*(x["at"] for x in xs)))
    third = lambda x, y: F.transform(others(x, y), lambda z: cell(x, y, z))
    cells = F.flatten(F.transform("r", lambda x: F.flatten(F.transform(others(x), lambda y: third(x, y)))))
    return top.where(F.size("r") >= 3).select("race_id", cells.alias("cells"))


def boxes(cube: np.ndarray) -> np.ndarray:
    """Races x a x b x c: the sum over the box that ends at each cell."""
    return cube.cumsum(1).cumsum(2).cumsum(3)


def choose(race: np.ndarray, at: np.ndarray, prob: np.ndarray, races: int, max_cards: int, points: int, target: float) -> Iterator[tuple]:
    """For each card: the races that have one, its last cell, its points and its gain. Of equal boxes the smallest in a, b, c."""
    n = int(at.max()) + 1
    valid, weight = np.zeros((races, n, n, n), np.int64), np.zeros((races, n, n, n))
    cell = (race, *at)
    with np.errstate(divide="ignore"):
        hot = (prob > 0) & (UNIT * PAYOUT_RATE["trifecta"] / prob >= target)
    valid[cell], weight[cell] = ~np.isnan(prob), np.where(hot, prob, 0.0)
    field = np.zeros(races, np.int64)
    np.maximum.at(field, race, at[0] + 1)
    side = np.arange(n)
    in_field = side < field[:, None]
    able = (side[:, None, None] < FIRST_MOST) & (side[:, None] < SECOND_MOST) & in_field[:, :, None, None] & in_field[:, None, :, None] & in_field[:, None, None]
    pts, left, line = boxes(valid), np.full(races, points), np.arange(races)
    for _ in range(max_cards):
        value = boxes(weight) / np.maximum(pts, 1)
        value = np.where(able & (pts > 0) & (pts <= left[:, None, None, None]), np.round(value, 15), 0.0).reshape(races, -1)
        best = value.argmax(1)  # the first of equal ones
        won = value[line, best] > 0
        a, b, c = np.unravel_index(best, (n, n, n))
        p = pts[line, a, b, c]
        yield won, a, b, c, p, value[line, best] * p
        inside = (side <= a[:, None])[:, :, None, None] & (side <= b[:, None])[:, None, :, None] & (side <= c[:, None])[:, None, None]
        weight[inside & won[:, None, None, None]] = 0.0
        left = left - np.where(won, p, 0)


def cards(races: DataFrame, max_cards: int, points: int, target: float) -> DataFrame:
    """The cards of races with their cells; a task's batch of races is one array."""
    kind = races.schema["race_id"].dataType
    prepare(races.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                cells = part["cells"]
                flat = cells.flatten()
                size = np.asarray(cells.value_lengths().fill_null(0))
                if not len(flat):
                    continue
                race = np.repeat(np.arange(len(size)), size)
                at = np.stack([flat.field(x).to_numpy() for x in "abc"]).astype(np.int64)
                prob = flat.field("prob").to_numpy(zero_copy_only=False)
                for k, (won, a, b, c, p, gain) in enumerate(choose(race, at, prob, len(size), max_cards, points, target)):
                    own = np.flatnonzero(won)
                    cols = [np.full(len(own), k + 1), *(x[own] + 1 for x in (a, b, c)), p[own], gain[own]]
                    yield pa.RecordBatch.from_arrays([part["race_id"].take(pa.array(own)), *map(pa.array, cols)], ["race_id", "card", "a", "b", "c", "points", "gain"])

    return races.select("race_id", "cells").mapInArrow(run, CARDS.format(kind.simpleString()))


def formation_cards(tensor: DataFrame, order: DataFrame, p: str, max_cards: int = 3, points: int = 120, target: float = 50_000.0, size: int = 10) -> DataFrame:
    """race_id, card, a, b, c, points, gain: up to ``max_cards`` cards of together at most ``points`` points, overlaps counted
    in each. tensor: race_id, i, j, k, prob by post; order: race_id, post_no and p. Of equal boxes the smallest in a, b, c."""
    return cards(tensor_cells(tensor, order, p, size), max_cards, points, target)


def ordered_cards(races: DataFrame, max_cards: int = 3, points: int = 120, target: float = 50_000.0, size: int = 10) -> DataFrame:
    """The same of races with their runners' strengths (``market.strengths``), whose triples are never rows."""
    return cards(order_cells(races, size), max_cards, points, target)
