"""Date-time stamps of five-second ticks, and calendars of 360 and 365 days, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nephos.functions.columns import once

#: Fixed values of the stamp: its first new-style number, ticks in a day, and seconds of 1980 in Unix time.
FIRST = 123_200_000
TICKS = 17_280
EPOCH_1980 = 315_532_800


def ticks(at: Column) -> Column:
    """Whole five-second ticks since 1980 of a timestamp."""
    return F.floor((F.unix_seconds(at.cast("timestamp")) - EPOCH_1980) / 5).cast("long")


def stamp(at: Column) -> Column:
    """New-style stamp from 2000 on, or from 1980 if minutes or seconds are not zero; before, the old style by month, day, year and hour."""
    t = ticks(at)
    new = FIRST + F.floor(t / 8) * 10 + F.pmod(t, F.lit(8))
    old = F.month(at) * 10_000_000 + F.dayofmonth(at) * 100_000 + (F.year(at) - 1900) * 1000 + F.hour(at) * 10
    late = (F.year(at) >= 2000) | ((F.year(at) >= 1980) & ((F.minute(at) != 0) | (F.second(at) != 0)))
    return F.when(late, new).otherwise(old).cast("long")


def unstamp(s: Column) -> Column:
    """The timestamp of a stamp."""
    past = s - FIRST
    new = F.timestamp_seconds(EPOCH_1980 + 5 * (F.floor(past / 10) * 8 + F.pmod(past, F.lit(10))))

    def part(divisor: int) -> Column:
        return F.pmod(F.floor(s / divisor), F.lit(100)).cast("int")

    old = F.make_timestamp(part(1000) + 1900, part(10_000_000), part(100_000), part(10), F.lit(0), F.lit(0))
    return F.when(s >= FIRST, new).otherwise(old)


def printable(at: Column) -> tuple[Column, Column]:
    """yyyymmdd and hhmmss00."""
    return (
        (F.year(at) * 10_000 + F.month(at) * 100 + F.dayofmonth(at)).cast("long"),
        (F.hour(at) * 1_000_000 + F.minute(at) * 10_000 + F.second(at) * 100).cast("long"),
    )


def system_time() -> tuple[Column, Column]:
    """The query's own time as a day (yyyymmdd) and a time of day (hhmmss00) of universal time."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyyMMdd").cast("int"), F.date_format(now, "HHmmss").cast("int") * 100


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) / 3600.0


def add_hours(at: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + F.round(hours * 3600).cast("long"))


def days_360(year: Column, month: Column, day: Column) -> Column:
    """Days since year 0 in the calendar of twelve months of 30 days."""
    return (year * 360 + (month - 1) * 30 + (day - 1)).cast("long")


def from_days_360(days: Column) -> tuple[Column, Column, Column]:
    rest = F.pmod(days, F.lit(360))
    return F.floor(days / 360).cast("int"), (F.floor(rest / 30) + 1).cast("int"), (F.pmod(rest, F.lit(30)) + 1).cast("int")


def days_365(year: Column, month: Column, day: Column) -> Column:
    """Days since year 0 in the calendar without leap years."""
    before = F.element_at(F.array(*[F.lit(d) for d in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)]), month.cast("int"))
    return (year * 365 + before + (day - 1)).cast("long")


def julian_day(year: Column, month: Column, day: Column) -> Column:
    """Julian day number of a Gregorian date."""
    return (F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date")) + 2_440_588).cast("long")


def from_julian_day(number: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (number - 2_440_588).cast("int"))


#: Fixed values of the words: names of days and months, what stands for an invalid stamp, and the start of extended stamps.
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
INVALID, EXTENDED = 101_010_101, 3_000_000_000
#: Days from the year 0 to 1970 in the Gregorian calendar.
DAYS_TO_1970 = 719_528


def _named(names: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int"))


def words(at: Column) -> Column:
    """A time as the words of a date group: weekday from 1 for Sunday, month, day, year, hour, hundredths of a second since the
    hour, and its text of 28 characters."""
    return once(at, _words)


def _words(at: Column) -> Column:
    second = F.minute(at) * 60 + F.second(at)
    text = F.concat(
        F.lit(" "), _named(DAYS, F.dayofweek(at)), F.lit(" "), _named(MONTHS, F.month(at)), F.lit(" "), F.lpad(F.dayofmonth(at).cast("string"), 2, "0"), F.lit(" "),
        F.lpad(F.year(at).cast("string"), 4, "0"), F.lit(" "), F.lpad(F.hour(at).cast("string"), 2, "0"), F.lit("Z"), F.lpad(F.minute(at).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.second(at).cast("string"), 2, "0"), F.lit(".00"),
    )
    return F.struct(F.dayofweek(at).alias("weekday"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.year(at).alias("year"), F.hour(at).alias("hour"), (second * 100).alias("hundredths"), F.substring(text, 1, 28).alias("text"))


def from_words(month: Column, day: Column, year: Column, hour: Column, hundredths: Column) -> Column:
    """The stamp of a date group; a year below 100 is one of the 1900s; 101010101 for what is no time."""
    full = F.when(year.between(0, 99), year + 1900).otherwise(year)
    date = F.try_make_timestamp(full, month, day, hour, F.floor(hundredths / 6000).cast("int"), F.pmod(F.floor(hundredths / 100), F.lit(60)).cast("double"))
    return F.coalesce(any_stamp(date), F.lit(INVALID)).cast("long")


def hours_of_year_0(at: Column) -> Column:
    """Whole hours since the year 0: the extended true date."""
    return (F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") + DAYS_TO_1970) * 24 + F.hour(at)


def extended_stamp(at: Column) -> Column:
    """Stamp of whole hours for any year from 0 to 9999, as the signed 32-bit number that its unsigned one is stored as."""
    return once(at, _extended_stamp)


def _extended_stamp(at: Column) -> Column:
    h = hours_of_year_0(at)
    return EXTENDED + F.floor(h / 8) * 10 + F.pmod(h, F.lit(8)) - (1 << 32)


def any_stamp(at: Column) -> Column:
    """The old or new stamp of years 1900 to 2235, the extended one of others and of 1901-01-01 01, whose old stamp marks errors."""
    return once(at, _any_stamp)


def _any_stamp(at: Column) -> Column:
    mark = (F.year(at) == 1901) & (F.month(at) == 1) & (F.dayofmonth(at) == 1) & (F.hour(at) == 1) & (F.minute(at) == 0) & (F.second(at) == 0)
    return F.when(mark | (F.year(at) < 1900) | (F.year(at) > 2235), extended_stamp(at)).otherwise(stamp(at)).cast("long")


def unstamp_any(s: Column) -> Column:
    """The time of an old, new or extended stamp."""
    return once(s, _unstamp_any)


def _unstamp_any(s: Column) -> Column:
    past = s + (1 << 32) - EXTENDED
    hours = F.floor(past / 10) * 8 + F.pmod(past, F.lit(10)) - DAYS_TO_1970 * 24
    return F.when(s < -1, F.timestamp_seconds(hours * 3600)).otherwise(unstamp(F.when(s >= 0, s)))


def true_date(s: Column) -> tuple[Column, Column]:
    """Five-second ticks since 1980 of an old or new stamp and its run number, 0 for new ones."""
    return once(s, lambda x: ticks(unstamp(x))), F.when(s >= FIRST, F.lit(0)).otherwise(F.pmod(s, F.lit(10))).cast("long")


def from_true_date(tick: Column, run: Column) -> Column:
    """The stamp of ticks and a run number, which old stamps keep."""
    return once(F.struct(tick.cast("long").alias("tick"), run.cast("long").alias("run")), lambda x: _from_true_date(x["tick"], x["run"]))


def _from_true_date(tick: Column, run: Column) -> Column:
    at = F.timestamp_seconds(EPOCH_1980 + 5 * tick)
    new = (tick >= 126_230_400) | (F.pmod(tick, F.lit(720)) != 0)
    old = F.month(at) * 10_000_000 + F.dayofmonth(at) * 100_000 + (F.year(at) - 1900) * 1000 + F.hour(at) * 10 + run
    return F.when(new, FIRST + F.floor(tick / 8) * 10 + F.pmod(tick, F.lit(8))).otherwise(old).cast("long")


def add_whole_hours(s: Column, hours: Column) -> Column:
    """A stamp so many whole hours later."""
    return any_stamp(once(unstamp_any(s), lambda at: add_hours(at, hours.cast("double"))))


def whole_hours_between(a: Column, b: Column) -> Column:
    """Hours from stamp b to stamp a, rounded."""
    return F.round(hours_between(unstamp_any(a), unstamp_any(b))).cast("long")


def operational(text: Column) -> Column:
    """The stamp of year, day of the year and hour as YYDDDHH; years below 50 are those of the 2000s; 10101011 for what is none."""
    return once(F.trim(text).try_cast("long"), _operational)


def _operational(n: Column) -> Column:
    year = 1900 + F.floor(n / 100_000)
    year = F.when(year < 1950, year + 100).otherwise(year)
    day = F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (F.pmod(F.floor(n / 100), F.lit(1000)) - 1).cast("int"))
    at = F.try_make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.pmod(n, F.lit(100)).cast("int"), F.lit(0), F.lit(0))
    return F.when(n < 9_936_624, any_stamp(at)).otherwise(F.lit(10_101_011)).cast("long")
