"""Fixed-width records: bytes to nested columns by a table of layouts, in built-in functions.

A layout has single fields and one group that repeats. Fields are cut out of the bytes, so a record costs its length however
many groups it has. A field of digits that has anything else, blanks and "----" included, is null. A record that is too short,
of an unknown type, or null has no fields and says why in ``bad``; it does not end the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """at: the first byte, from 1."""

    name: str
    at: int
    width: int
    digits: bool = True


@dataclass(frozen=True)
class Layout:
    kind: str
    length: int
    at: int
    count: int
    size: int
    group: tuple[Field, ...]


def _odds(kind: str, length: int, at: int, count: int, size: int, combo: int, odds: int, rank_at: int, rank: int) -> Layout:
    return Layout(kind, length, at, count, size, (Field("combo", 1, combo), Field("odds10", combo + 1, odds), Field("popularity", rank_at, rank)))


# The header of all records, and by record type the kind of bet, the record's length, the first byte of the
# groups, their number and size, the digits of combination and odds, and where and how wide the popularity is.
HEADER = (Field("state", 3, 1, False), Field("made", 4, 8), Field("year", 12, 4, False), Field("month_day", 16, 4, False), Field("meeting", 20, 6, False), Field("number", 26, 2, False), Field("announced", 28, 8, False))
ODDS_LAYOUTS = {
    "O1": _odds("win", 962, 44, 28, 8, 2, 4, 7, 2),
    "O2": _odds("quinella", 2042, 41, 153, 13, 4, 6, 11, 3),
    "O3": _odds("wide", 2654, 41, 153, 17, 4, 5, 15, 3),
    "O4": _odds("exacta", 4031, 41, 306, 13, 4, 6, 11, 3),
    "O5": _odds("trio", 12293, 41, 816, 15, 6, 6, 13, 3),
    "O6": _odds("trifecta", 83285, 41, 4896, 17, 6, 7, 14, 4),
}


def _cut(raw: Column, at: Column, field: Field) -> Column:
    """The field that starts at byte ``at``; the bytes are taken as they are, without reading the record as text."""
    text = F.substring(raw, at, F.lit(field.width)).cast("string")
    if not field.digits:
        return F.trim(text)
    return F.when(text.rlike(f"^[0-9]{{{field.width}}}$"), text.cast("long"))


def _groups(raw: Column, layout: Layout) -> Column:
    def one(i: Column) -> Column:
        return F.struct(*(_cut(raw, i * layout.size + (layout.at + f.at - 1), f).alias(f.name) for f in layout.group))

    return F.transform(F.sequence(F.lit(0), F.lit(layout.count - 1)), one)


def decode(records: DataFrame, raw: str = "raw", layouts: dict[str, Layout] = ODDS_LAYOUTS) -> DataFrame:
    """records without the bytes, with record_type, kind, the header's fields, ``groups`` (array of combo, odds10, popularity)
    and bad. Groups without a combination are left out; odds and popularities of 0 are null."""
    code = F.substring(F.col(raw), 1, 2).cast("string")
    need = lambda x: x.at - 1 + x.count * x.size
    some = lambda c: F.when(c > 0, c)
    kind = F.lit(None).cast("string")
    for name, x in layouts.items():
        kind = F.when(code == name, x.kind).otherwise(kind)

    def kept(r: Column) -> Column:
        of, size, groups = F.substring(r, 1, 2).cast("string"), F.octet_length(r), None
        for name, x in layouts.items():
            own = F.when((of == name) & (size >= need(x)), _groups(r, x))
            groups = own if groups is None else F.coalesce(groups, own)
        found = F.filter(groups, lambda g: g["combo"] > 0)
        return F.transform(found, lambda g: F.struct(g["combo"].alias("combo"), some(g["odds10"]).alias("odds10"), some(g["popularity"]).alias("popularity")))

    def fault(r: Column) -> Column:
        of, size = F.substring(r, 1, 2).cast("string"), F.octet_length(r)
        known, short = F.lit(False), F.lit(False)
        for name, x in layouts.items():
            known, short = known | (of == name), short | ((of == name) & (size < need(x)))
        return F.when(r.isNull(), "no record").when(~F.coalesce(known, F.lit(False)), "unknown type").when(short, "too short")

    # the record is bound once: a filter on what is made of it would else make it anew for every place where its bytes are named
    bound = lambda f: F.get(F.transform(F.array(F.col(raw)), f), F.lit(0))
    bad = bound(fault)
    out = records.withColumns({"record_type": code, "kind": kind, "bad": bad})
    fine = F.col("bad").isNull()
    out = out.withColumns({f.name: F.when(fine, _cut(F.col(raw), F.lit(f.at), f)) for f in HEADER})
    return out.withColumns({"made": F.coalesce("made", F.when(fine, F.lit(0).cast("long"))), "groups": F.when(fine, bound(kept)), "race": F.concat("year", "meeting", "number"), "date": F.concat("year", "month_day")}).drop(raw)


def each_group() -> Column:
    """g, a group a row, null where there is none. The outer form, as ``explode`` has Spark put a filter on the array's size
    below, which reads the record a second time."""
    return F.explode_outer("groups").alias("g")


def odds_rows(decoded: DataFrame) -> DataFrame:
    """A row for each combination: record_type, kind, race, date, state, made, announced, combo, odds10, popularity."""
    each = decoded.where("bad is null").select("record_type", "kind", "race", "date", "state", "made", "announced", each_group())
    return each.where("g is not null").select(*each.columns[:-1], "g.*")
