"""Tables from CSV files with a header: columns by name, whatever their order, typed where they can be.

A byte order mark, quotes, line breaks within quotes and blanks around values are dealt with. A value that its type cannot
hold is null. Columns that the layout does not name are left out; one that it names and the file lacks is null, or an error if
it is needed. A file that is not there is an empty table if it may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextColumn:
    """name: in the result. source: in the file's header. kind: string, long, double, date or a timestamp's pattern."""

    name: str
    source: str
    kind: str = "string"
    needed: bool = False


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_csv(spark: SparkSession, path: str, layout: list[TextColumn], optional: bool = False, encoding: str = "UTF-8", line_breaks: bool = False) -> DataFrame:
    """The layout's columns of a file or folder. line_breaks: values can have them; such files cannot be split among tasks."""
    if not exists(spark, path):
        if optional:
            return spark.createDataFrame([], ", ".join(f"{c.name} {'timestamp' if c.kind not in ('string', 'long', 'double', 'date') else c.kind}" for c in layout))
        raise FileNotFoundError(path)
    raw = spark.read.options(header=True, encoding=encoding, escape='"', multiLine=line_breaks, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    named = {c.lstrip("﻿").strip(): i for i, c in enumerate(raw.columns)}
    raw = raw.toDF(*(f"_{i}" for i in range(len(raw.columns))))
    lacking = [c.source for c in layout if c.needed and c.source not in named]
    if lacking:
        raise ValueError(f"{path} has no columns {lacking}")
    out = []
    for c in layout:
        text = F.col(f"_{named[c.source]}") if c.source in named else F.lit(None).cast("string")
        text = F.nullif(F.trim(text), F.lit(""))
        if c.kind == "long":
            # "7.0" is a 7, "7.5" is none
            number = text.try_cast("double")
            value = F.coalesce(text.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))
        elif c.kind in ("string", "double", "date"):
            value = text.try_cast(c.kind)
        else:
            value = F.try_to_timestamp(text, F.lit(c.kind))
        out.append(value.alias(c.name))
    return raw.select(*out)


#: Results of races as exported: the columns that the analytics read.
RESULTS = [
    TextColumn("race_id", "race_id", "long", True),
    TextColumn("race_date", "race_date", "date", True),
    TextColumn("post_no", "post_no", "long", True),
    TextColumn("horse_id", "horse_id", "long"),
    TextColumn("finish_rank", "finish_rank", "long"),
    TextColumn("win_odds", "win_odds", "double"),
    TextColumn("grade", "grade"),
]
#: Predictions as logged, with the time that they were made at.
PREDICTIONS = [TextColumn("race_id", "race_id", "long", True), TextColumn("post_no", "post_no", "long", True), TextColumn("p", "p", "double"), TextColumn("made", "made", "yyyy-MM-dd HH:mm:ss")]


def results(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """Rows of results; those without a race or a date are left out."""
    return read_csv(spark, path, RESULTS, optional).where("race_id is not null and race_date is not null")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Of each runner the prediction that was made last; a file that is not there has none."""
    rows = read_csv(spark, path, PREDICTIONS, optional=True).where("race_id is not null and post_no is not null")
    best = rows.groupBy("race_id", "post_no").agg(F.max_by("p", F.struct(F.coalesce("made", F.timestamp_seconds(F.lit(0))), "p")).alias("p"), F.max("made").alias("made"))
    return best.select("race_id", "post_no", "p", "made")
