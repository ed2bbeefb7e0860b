"""Dates of documents: as printed in a file's metadata, and how long ago an edit was."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86400


def pdf_date(text: Column) -> Column:
    """Timestamp of `D:YYYYMMDDHHmmSS...` (the prefix may lack) or of an ISO date; offsets are dropped. Null for anything else, and for dates that don't exist."""
    bare = F.regexp_replace(F.trim(text), "^D:", "")
    digits = F.regexp_extract(bare, r"^([0-9]{14})", 1)
    iso = F.regexp_extract(F.substring(bare, 1, 19), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2})?$", 0)
    day, clock = F.substring(iso, 1, 10), F.when(F.length(iso) > 10, F.substring(iso, 12, 8)).otherwise("00:00:00")
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).when(iso != "", F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")))


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds, never negative; null if either is."""
    return F.abs(b.cast("double") - a.cast("double"))


def edit_age(modified: Column, now: Column) -> Column:
    """Struct days_ago, human_readable, risk_factor, is_recent, is_very_recent; a later date than now counts as negative days."""
    seconds = now.cast("long") - modified.cast("long")
    days = F.floor(seconds / DAY)
    rest = seconds - days * DAY
    hours, minutes = F.floor(rest / 3600), F.floor(rest % 3600 / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    # the first that holds: words and risk
    steps = [
        (modified.isNull(), F.lit("Unknown"), 1.0),
        ((days == 0) & (hours == 0) & (minutes > 0), F.concat(minutes.cast("string"), F.lit(" minutes ago")), 1.5),
        ((days == 0) & (hours == 0), F.lit("Just now"), 1.5),
        (days == 0, F.concat(hours.cast("string"), F.lit(" hours ago")), 1.3),
        (days < 7, ago(days, "day"), 1.2),
        (days < 30, ago(F.floor(days / 7), "week"), 1.0),
        (days < 365, ago(F.floor(days / 30), "month"), 0.9),
    ]
    human, risk = ago(F.floor(days / 365), "year"), F.lit(0.8)
    for holds, words, factor in reversed(steps):
        human, risk = F.when(holds, words).otherwise(human), F.when(holds, F.lit(factor)).otherwise(risk)
    return F.struct(days.cast("long").alias("days_ago"), human.alias("human_readable"), risk.alias("risk_factor"), F.coalesce(days < 1, F.lit(False)).alias("is_recent"), F.coalesce((days == 0) & (hours < 3), F.lit(False)).alias("is_very_recent"))


def described(at: Column, now: Column) -> Column:
    """Struct iso8601, formatted, human, relative, age_days, epoch of a timestamp in UTC; null for null."""
    age = edit_age(at, now)
    hours = F.floor((now.cast("long") - at.cast("long")) % DAY / 3600)
    relative = F.when(age["days_ago"] != 0, age["human_readable"]).when(hours > 0, F.concat(hours.cast("string"), F.lit(" hours ago"))).otherwise("Just now")
    parts = {
        "iso8601": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "formatted": F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        "human": F.date_format(at, "MMMM dd, yyyy 'at' hh:mm a"),
        "relative": relative,
        "age_days": age["days_ago"],
        "epoch": at.cast("long"),
    }
    return F.when(at.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))
