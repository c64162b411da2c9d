"""Column expressions for the text fields of race records: numbers, times, codes, keys and combinations.

A field that cannot be read, or that holds one of its codes for "missing", becomes null. None of these raises in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Track codes.
TURF, DIRT, SAND, JUMP = (10, 22), (23, 24, 25, 26, 29), (27, 28), (51, 59)
LEFT = (11, 12, 13, 14, 15, 16, 23, 25, 27, 53)
RIGHT = (17, 18, 19, 20, 21, 22, 24, 26, 28)
STRAIGHT = (10, 29)
OUTER, IN_TO_OUT, OUT_TO_IN = (12, 16, 18, 22, 26, 55, 59), (13, 19, 57), (14, 20, 56)
# Level of a grade, and the payout that is "hot" for a stake.
GRADE_LEVEL = {"A": 9, "B": 8, "C": 7, "D": 7, "F": 9, "G": 8, "H": 7, "L": 6}
HOT_TIERS = {1000: 10_000, 3000: 20_000, 5000: 30_000, 10_000: 50_000}
# Share of the stakes that is paid out, by kind of bet.
PAYOUT_RATE = {"exacta": 0.75, "quinella": 0.775, "trio": 0.75, "trifecta": 0.725}


def to_number(c: Column, missing: tuple[str, ...] = ()) -> Column:
    """The number that the trimmed text is."""
    t = F.trim(c)
    return F.when(~t.isin("", *missing), t.try_cast("double"))


def to_tenths(c: Column, missing: tuple[str, ...] = ()) -> Column:
    """"345" is 34.5."""
    return to_number(c, missing) / 10


def race_time(c: Column) -> Column:
    """"1345" is one minute and 34.5 seconds, "0000" none."""
    v = to_number(c, ("0000",))
    return F.floor(v / 1000) * 60 + F.pmod(v, F.lit(1000)) / 10


def signed_difference(sign: Column, size: Column) -> Column:
    """The size under its sign; nought needs no sign, "999" is missing."""
    v = to_number(size, ("999",))
    return F.when(v == 0, 0.0).when(F.trim(sign) == "+", v).when(F.trim(sign) == "-", 0 - v)


def time_difference(c: Column) -> Column:
    """"+005" is half a second behind, "-003" 0.3 seconds ahead; other texts are missing."""
    t = F.trim(c)
    v = F.substring(t, 2, 3).try_cast("double") / 10
    return F.when(t.rlike(r"^[+-][0-9]{3}$"), F.when(t.startswith("-"), 0 - v).otherwise(v))


def start_minutes(c: Column) -> Column:
    """"1525" is minute 925 of the day."""
    t = F.trim(c)
    full = F.lpad(t, 4, "0")
    return F.when(t.rlike("^[0-9]{3,4}$"), F.substring(full, 1, 2).try_cast("int") * 60 + F.substring(full, 3, 2).try_cast("int"))


def _code(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def track_surface(c: Column) -> Column:
    n = _code(c)
    return F.when(n.between(*TURF), "turf").when(n.isin(*DIRT), "dirt").when(n.isin(*SAND), "sand").when(n.between(*JUMP), "jump")


def track_turn(c: Column) -> Column:
    n = _code(c)
    return F.when(n.isin(*STRAIGHT), "straight").when(n.isin(*LEFT), "left").when(n.isin(*RIGHT), "right")


def track_course(c: Column) -> Column:
    """Outer or inner course; a straight one has neither."""
    n = _code(c)
    return F.when(n.isin(*OUTER), "outer").when(n.isin(*IN_TO_OUT), "in-out").when(n.isin(*OUT_TO_IN), "out-in").when(n.isin(*STRAIGHT), None).when(n.isNotNull(), "inner")


def condition_level(c: Column) -> Column:
    """Level 0 to 5 of the conditions of entry."""
    t = F.trim(c)
    n = F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    return F.when(n.isin(701, 702), 0).when(n == 703, 1).when(n == 999, 5).when(n.between(1, 5), 2).when(n.between(6, 10), 3).when(n.between(11, 100), 4)


def class_level(conditions: list[Column], grade: Column) -> Column:
    """The highest of the conditions' levels and the grade's; those that are missing do not count."""
    by_grade = F.create_map(*(F.lit(x) for kv in GRADE_LEVEL.items() for x in kv))[F.trim(grade)]
    return F.greatest(by_grade, *(condition_level(c) for c in conditions))


def normalized_id(c: Column) -> Column:
    """An id as text, without blanks around it and without ".0" at its end."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def race_key(year: Column, venue: Column, meeting: Column, day: Column, race: Column) -> Column:
    return F.concat(F.lpad(F.trim(year), 4, "0"), *(F.lpad(F.trim(c), 2, "0") for c in (venue, meeting, day, race)))


def live_key(key: Column, date: Column) -> Column:
    """Key of a race in the live feed: its date, then venue, meeting, day and race."""
    return F.concat(F.date_format(date, "yyyyMMdd"), F.substring(key, 5, 8))


def record_date(year: Column, month_day: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lpad(F.trim(year), 4, "0"), F.lpad(F.trim(month_day), 4, "0")), F.lit("yyyyMMdd")).cast("date")


def date_number(c: Column) -> Column:
    """A date as the number YYYYMMDD, 0 if it is missing."""
    return F.coalesce((F.year(c) * 10_000 + F.month(c) * 100 + F.dayofmonth(c)).cast("long"), F.lit(0).cast("long"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    """Inverse of ``logit``; no power overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def hot_threshold(stake: Column) -> Column:
    """The hot payout of the tier nearest to the stake; of two as near, the lower tier."""
    tiers = F.array(*(F.struct(F.abs(stake - k).alias("far"), F.lit(k).alias("tier"), F.lit(v).alias("hot")) for k, v in HOT_TIERS.items()))
    return F.when(stake.isNotNull(), F.array_min(tiers)["hot"])


def estimated_payout(prob: Column, kind: str) -> Column:
    """What 100 pay if stakes follow the probabilities."""
    return F.when(prob > 0, 100 * PAYOUT_RATE[kind] / prob)


def performance_correction(n: Column) -> Column:
    """Discount of a rating after n starts: 1200 before the first, nearing 0 with many."""
    f = (F.sqrt(1 - F.pow(F.lit(0.81), n)) / F.nullif(1 - F.pow(F.lit(0.9), n), F.lit(0.0)) - 1) / (F.sqrt(F.lit(19.0)) - 1) * 1200
    return F.when(n >= 1, f).otherwise(1200.0)


def combination(code: Column, size: int) -> Column:
    """The post numbers of a combination that is written as one number of two digits each."""
    t = F.lpad(code.cast("string"), 2 * size, "0")
    return F.array(*(F.substring(t, 2 * k + 1, 2).try_cast("int") for k in range(size)))


def combination_text(posts: Column, ordered: bool) -> Column:
    """"3→1→2" where the order counts, else "1-2-3"."""
    return F.array_join(posts, "→") if ordered else F.array_join(F.array_sort(posts), "-")


def combination_key(posts: Column, ordered: bool) -> Column:
    """Text by which two bets on the same combination are equal."""
    own = posts if ordered else F.array_sort(posts)
    return F.array_join(F.transform(own, lambda x: F.lpad(x.cast("string"), 2, "0")), "")


def days_of(spec: Column) -> Column:
    """All dates of a list such as "20240105,20240110-20240112"; parts that are no dates are left out."""
    day = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyyMMdd")).cast("date")
    first, last = lambda p: day(F.substring_index(p, "-", 1)), lambda p: day(F.substring_index(p, "-", -1))
    spans = F.filter(F.split(spec, ","), lambda p: first(p) <= last(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda p: F.sequence(first(p), last(p))))))


def post_time(date: Column, hhmm: Column) -> Column:
    """Time of the start; null if the text is no time of the day."""
    m = start_minutes(hhmm)
    return F.when((m >= 0) & (m < 1440), date.cast("timestamp_ntz") + F.make_dt_interval(mins=m))


def minutes_before(start: Column, now: Column) -> Column:
    """Whole minutes from now to the start, rounded down."""
    return F.floor((F.unix_micros(start.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 60_000_000)


def stage(minutes: Column, final: int = 15, provisional: int = 25) -> Column:
    """Phase of a race by the minutes to its start."""
    return F.when(minutes < 0, "after").when(minutes < final, "final").when(minutes <= provisional, "provisional").when(minutes.isNotNull(), "latest")
