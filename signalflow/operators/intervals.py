"""Joins with what happened in the time before a row, as equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_recent(rows: DataFrame, before: DataFrame, keys: list[str], at: str, seen_at: str, days: int) -> DataFrame:
    """Each of rows with each of before of equal keys whose seen_at lies in the days up to at, both ends included.

    Time is cut into stretches as long as the interval, so that what a row asks for lies in its own stretch and the one before: before is
    entered in two stretches, and keys and stretch make an equality join with the exact times as a condition. So a key that many rows share is
    split by time. Null times and null keys meet nothing; other columns of before must have names that rows lacks, and its keys are dropped.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    width = days * 86_400
    stretch = lambda c: F.floor(F.unix_timestamp(c) / width).cast("long")
    asked = rows.withColumn("__stretch", stretch(at))
    entered = before.withColumn("__stretch", F.explode(F.array(stretch(seen_at), stretch(seen_at) + 1)))
    in_time = (F.col(seen_at) <= F.col(at)) & (F.col(seen_at) >= F.col(at) - F.expr(f"INTERVAL {days} DAYS"))
    return asked.join(entered, [*keys, "__stretch"]).where(in_time).drop("__stretch")
