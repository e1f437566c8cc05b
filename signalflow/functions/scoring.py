"""Scores, categories, costs and times of events and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the categories of an alert score.
CATEGORIES = [(90, "CRITICAL"), (75, "RELEVANT"), (60, "INTERESTING")]
LOCAL_ZONE = "America/Argentina/Buenos_Aires"


def alert_score(alert: Column, confidence: Column, trust: Column, is_primary: Column, hype: Column) -> Column:
    """The model's alert score scaled by confidence, moved by trust and a primary source, less hype; rounded half to even,
    0 to 100."""
    value = alert * (0.75 + confidence * 0.25) + (trust - 80) * 0.1 + F.when(is_primary, 2).otherwise(0) - hype * 20
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value, 0).cast("int")))


def category(score: Column) -> Column:
    out = F.lit("IGNORE")
    for bound, name in reversed(CATEGORIES):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def llm_cost(input_tokens: Column, output_tokens: Column, input_rate: float, output_rate: float) -> Column:
    """Dollars for tokens at rates per million."""
    return (input_tokens * F.lit(float(input_rate)) + output_tokens * F.lit(float(output_rate))) / 1_000_000


def effective_date(published_at: Column, discovered_at: Column) -> Column:
    return F.coalesce(published_at, discovered_at)


def is_historical(at: Column, as_of: Column, days: int = 30) -> Column:
    """Whether a time is more than so many days before as_of; null if there is none."""
    return at < as_of - F.expr(f"INTERVAL {days} DAYS")


def local_time(at: Column, zone: str = LOCAL_ZONE, pattern: str = "dd MMM yyyy · HH:mm") -> Column:
    """A UTC time as text in a fixed zone; a dash for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), pattern), F.lit("—"))


def relative_time(at: Column, as_of: Column) -> Column:
    """How long ago, in words; times to come are just now; a dash for null."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(at))
    minutes = F.floor(seconds / 60)
    return (
        F.when(at.isNull(), "—")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def duration_seconds(started_at: Column, finished_at: Column) -> Column:
    """Seconds that a run took; null while it runs."""
    return F.unix_timestamp(finished_at) - F.unix_timestamp(started_at)


def period_key(hours: int, as_of: Column) -> Column:
    """The name of a rolling period, the same within an hour."""
    return F.concat_ws(":", F.lit("rolling"), F.lit(str(hours)), F.date_format(F.date_trunc("hour", as_of), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def source_status(http_status: Column, items: Column, latest: Column, valid: Column, as_of: Column, stale_days: int = 30) -> Column:
    """The first that fits of HTTP_ERROR, PARSE_ERROR, EMPTY and STALE, else OK."""
    return (
        F.when(http_status != 200, "HTTP_ERROR").when(~valid, "PARSE_ERROR").when(items == 0, "EMPTY")
        .when(latest < as_of - F.expr(f"INTERVAL {stale_days} DAYS"), "STALE").otherwise("OK")
    )
