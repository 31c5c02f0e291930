"""Dates as photo and video metadata write them.

A date is read as wall clock time; the offset in a video date is dropped.  A day past the end of its month counts as
the last day, and 24:00:00 as the next midnight; anything else out of range does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts of photo and video dates, and the month names.
PHOTO_LAYOUT = r"^(\d{4}:\d{2}:\d{2}|\d{4}/\d{2}/\d{2}) \d{2}:\d{2}:\d{2}$"
VIDEO_LAYOUT = (
    r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{1,2}) "
    r"(\d{2}):(\d{2}):(\d{2}) (GMT|[+-]\d{2}(:?\d{2}){0,2}) (\d{4})$"
)
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def photo_fields(text: Column) -> Column:
    """[year, month, day, hour, minute, second], NULL where the layout does not fit."""
    numbers = F.transform(F.split(text, "[^0-9]"), lambda part: part.try_cast("int"))
    return F.when(text.rlike(PHOTO_LAYOUT), numbers)


def video_fields(text: Column) -> Column:
    month = F.floor((F.position(F.initcap(F.substring(text, 5, 3)), F.lit(MONTHS)) + 2) / 3)
    words = F.split(text, " ")
    clock = F.split(words[3], ":")
    parts = [words[5], month, words[2], clock[0], clock[1], clock[2]]
    return F.when(text.rlike(VIDEO_LAYOUT), F.array(*[part.try_cast("int") for part in parts]))


def moment(fields: Column) -> Column:
    """Timestamp of such fields, NULL where one is out of range."""
    year, month, day, hour, minute, second = (fields[i] for i in range(6))
    midnight = (hour == 24) & (minute == 0) & (second == 0)
    fits = (
        (year >= 1) & month.between(1, 12) & day.between(1, 31) & ((hour <= 23) | midnight)
        & (minute <= 59) & (second <= 59)
    )
    first = F.when(fits, F.make_date(year, month, F.lit(1)))
    date = F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)
    clock = F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))
    return date.cast("timestamp_ntz") + clock


def names_photo_date(text: Column) -> Column:
    """Whether the text is meant as a date; zeros and texts without "/" or ":" stand for none."""
    return text.contains("/") | (text.contains(":") & ~text.startswith("0000:00:00"))


def weekday_fits(text: Column, fields: Column) -> Column:
    """A video date has to name the weekday of its day."""
    midnight = F.array(fields[0], fields[1], fields[2], F.lit(0), F.lit(0), F.lit(0))
    return F.date_format(moment(midnight), "E") == F.initcap(F.substring(text, 1, 3))
