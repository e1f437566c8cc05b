"""Health of sources, and upserts of the small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S


def item_stats(items: DataFrame, source: str = "source_name") -> DataFrame:
    """Items and latest date per source; unknown dates are not counted as latest."""
    return items.groupBy(source).agg(F.count("*").alias("items_found"), F.max("published_at").alias("latest_item_at"))


def with_status(found: DataFrame, as_of: Column) -> DataFrame:
    """found (http_status, items_found, latest_item_at, valid) with status."""
    return found.withColumn("status", S.source_status(F.col("http_status"), F.col("items_found"), F.col("latest_item_at"), F.col("valid"), as_of))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, the one of the highest order for each key; old rows come before new ones of equal order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_k", last).where("_k = 1").drop("_new", "_k")


def synced_profiles(stored: DataFrame, config: DataFrame) -> DataFrame:
    """Profiles by slug: those of the config as they are there; stored ones that it lacks stay, disabled."""
    c = config.select("slug", F.col("name").alias("_name"), F.col("icon").alias("_icon"), F.col("enabled").alias("_enabled"))
    j = stored.select("slug", "name", "icon", "enabled").join(c, "slug", "full_outer")
    return j.select("slug", F.coalesce("_name", "name").alias("name"), F.coalesce("_icon", "icon").alias("icon"), F.coalesce("_enabled", F.lit(False)).alias("enabled"))
