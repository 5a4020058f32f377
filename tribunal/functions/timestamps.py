"""Whether a text is a timestamp in ISO 8601, as column expressions; the forms are those that datetime.fromisoformat takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a date (by month or by week) and of a time with its fraction.
MONTHS, WEEKS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{8}$", r"^[0-9]{4}-W[0-9]{2}(-[0-9])?$|^[0-9]{4}W[0-9]{2}[0-9]?$"
TIME = r"^([0-9]{2}|[0-9]{2}:[0-9]{2}|[0-9]{4})([.,][0-9]+)?$|^[0-9]{2}:[0-9]{2}:[0-9]{2}([.,:][0-9]+)?$|^[0-9]{6}([.,][0-9]+|[0-9]{2,})?$"
#: What Python 3.13 takes besides in front of an offset: one more character, or anything after six digits of a fraction.
LOOSE = r"(?s)^([0-9]{2}|[0-9]{2}:[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{4}|[0-9]{6}).$|^(([0-9]{2}|[0-9]{2}:[0-9]{2}|[0-9]{4})[.,]|[0-9]{2}:[0-9]{2}:[0-9]{2}[.,:]|[0-9]{6}[.,]?)[0-9]{6}"


def _number(x: Column, first: int, size: int) -> Column:
    """Some digits as a number; 0 where there are none."""
    return F.coalesce(F.substring(x, first, size).try_cast("int"), F.lit(0))


def _date_length(t: Column) -> Column:
    """How many characters the date has. After a week, digits can be the weekday or a time after a separator; that is settled by how many there are."""
    at = lambda k: F.substring(t, k + 1, 1)
    n, digit = F.char_length(t), r"^[0-9]$"
    dashed = F.when((n > 8) & (at(8) == "-"), F.when((n > 10) & at(10).rlike(digit), 8).otherwise(10)).otherwise(8)
    digits = 7 + F.char_length(F.regexp_extract(F.substring(t, 8, 1 << 20), "^[0-9]*", 0))
    plain = F.when(digits < 9, digits).when(digits % 2 == 0, 7).otherwise(8)
    return F.when(at(4) == "-", F.when(at(5) == "W", dashed).otherwise(10)).when(at(4) == "W", plain).otherwise(8)


def _is_date(d: Column) -> Column:
    bare = F.regexp_replace(d, "[-W]", "")
    y, m, day = _number(bare, 1, 4), _number(bare, 5, 2), _number(bare, 7, 2)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    by_month = m.between(1, 12) & day.between(1, days)
    weekday = F.when(F.char_length(bare) > 6, _number(bare, 7, 1)).otherwise(1)
    first = (y + F.floor((y - 1) / 4) - F.floor((y - 1) / 100) + F.floor((y - 1) / 400)) % 7  # of the year: 0 is a Sunday
    weeks = F.when((first == 4) | ((first == 3) & leap), 53).otherwise(52)
    by_week = m.between(1, weeks) & weekday.between(1, 7) & ~((y == 9999) & (m == 52) & (weekday > 5))
    return (y > 0) & F.when(d.rlike(MONTHS), by_month).when(d.rlike(WEEKS), by_week).otherwise(False)


def _seconds(t: Column) -> tuple[Column, Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(t, "[.,].*", ""), ":", "")
    return _number(bare, 1, 2), _number(bare, 3, 2), _number(bare, 5, 2)


def _is_time(t: Column) -> Column:
    """With an offset of less than a day, or none."""
    sign = F.char_length(F.regexp_extract(t, "^[^+-]*", 0))
    own, offset = F.substr(t, F.lit(1), sign), F.substr(t, sign + 2)
    (h, m, s), (oh, om, os_) = _seconds(own), _seconds(offset)
    alone = sign == F.char_length(t)
    zone = offset.rlike(TIME) & (oh * 3600 + om * 60 + os_ < 86_400)
    return F.when(alone, own.rlike(TIME)).otherwise((own.rlike(TIME) | own.rlike(LOOSE)) & zone) & (h < 24) & (m < 60) & (s < 60)


def is_timestamp(text: Column) -> Column:
    """A date, or a date, any one character, and a time. Z is the offset +00:00. Null is no timestamp."""
    t = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    n = _date_length(t)
    rest = F.substr(t, n + 2)
    return F.coalesce((F.char_length(t) >= 7) & _is_date(F.substr(t, F.lit(1), n)) & ((F.char_length(t) <= n) | _is_time(rest)), F.lit(False))
