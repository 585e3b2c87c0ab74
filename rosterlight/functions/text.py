"""Scalar helpers over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of all values joined by bars; a null counts as an empty text (concat_ws alone would drop it)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def normal(c: Column) -> Column:
    """Lower case, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first: ``ann-lee`` becomes ``Ann-Lee``, which initcap does not do."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def hours_total(c: Column) -> Column:
    """Hours of ``Total: 8 hrs 20 min``, two decimals; null without such a total."""
    low = F.lower(c)
    pattern = r"total:\s*(\d+)\s*hrs?(?:\s*(\d+)\s*min)?"
    hours, minutes = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    return F.when(hours != "", F.round(hours.cast("double") + F.coalesce(F.nullif(minutes, F.lit("")).cast("double"), F.lit(0.0)) / 60, 2))


def first_line(c: Column) -> Column:
    return F.trim(F.get(F.split(c, "\n"), F.lit(0)))


def minute_label(c: Column) -> Column:
    """390 -> 6:30am."""
    hour = F.floor(c / 60) % 24
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d%s", twelve.cast("int"), (c % 60).cast("int"), F.when(hour < 12, "am").otherwise("pm"))


def clock_text(c: Column) -> Column:
    """390 -> 06:30."""
    return F.format_string("%02d:%02d", F.floor(c / 60).cast("int"), (c % 60).cast("int"))


def minutes_text(c: Column) -> Column:
    """Seconds 305 -> 5:05."""
    return F.format_string("%d:%02d", F.floor(c / 60).cast("int"), (c % 60).cast("int"))


def parsed_minute(c: Column) -> Column:
    """6:30am, 6:30 AM or 18:30 -> minute of the day; null if it is no time."""
    hour = F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,2}):(\d{2})\s*([ap]m)?$", 1)
    minute = F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,2}):(\d{2})\s*([ap]m)?$", 2)
    half = F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,2}):(\d{2})\s*([ap]m)?$", 3)
    h = F.try_to_number(F.nullif(hour, F.lit("")), F.lit("99")).cast("int")
    h = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(hour != "", h * 60 + minute.try_cast("int"))


def sunday_of(d: Column) -> Column:
    return F.date_sub(d, (F.weekday(d) + 1) % 7)


def monday_of(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")
