"""Time expressions. Every rolling window takes its present as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of digests, unless they are given another.
ZONE = "Europe/Berlin"


def minutes_after(epoch: str, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + minutes * 60)


def within(moment: Column, as_of: Column, *, hours: int = 0, days: int = 0) -> Column:
    """Moment is at most that long before as_of."""
    return moment >= as_of - F.make_dt_interval(F.lit(days), F.lit(hours))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def hhmm(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d", hour, minute)


def parse_times(text: Column) -> Column:
    """Array of minutes of the day from an 'HH:MM, HH:MM' list; what is no time is dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.split(F.trim(t), ":"))
    whole = F.transform(parts, lambda p: F.when(F.size(p) == 2, F.struct(F.try_to_number(F.get(p, 0), F.lit("99")).cast("int").alias("h"), F.try_to_number(F.get(p, 1), F.lit("99")).cast("int").alias("m"))))
    good = F.filter(whole, lambda x: x["h"].between(0, 23) & x["m"].between(0, 59))
    return F.transform(good, lambda x: x["h"] * 60 + x["m"])


def minute_label(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def ago(hours: Column) -> Column:
    """T14: '40m ago', '6h ago', '11d ago', 'never'."""
    return (
        F.when(hours.isNull(), "never")
        .when(hours < 1, F.concat(F.greatest(F.floor(hours * 60), F.lit(1)).cast("string"), F.lit("m ago")))
        .when(hours < 48, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def countdown(minutes: Column) -> Column:
    """T27."""
    return F.format_string("%dh %02dm", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def shifted(minute: Column, by: int) -> Column:
    """Minutes of the day, wrapping at midnight."""
    return F.pmod(minute + by, F.lit(1440))


def day_label(moment: Column, as_of: Column, zone: str = ZONE) -> Column:
    """HH:MM today, 'yday HH:MM' yesterday, dd/MM HH:MM before, in the digest's zone."""
    local, now = F.from_utc_timestamp(moment, zone), F.from_utc_timestamp(as_of, zone)
    time = F.date_format(local, "HH:mm")
    days = F.datediff(now.cast("date"), local.cast("date"))
    return F.when(days == 0, time).when(days == 1, F.concat(F.lit("yday "), time)).otherwise(F.concat(F.date_format(local, "dd/MM "), time))
