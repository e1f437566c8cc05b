"""The given tables as candidates, articles, events, scores and runs.

Rules use integer arithmetic only, so that the SQL twins in plans/twins.py are equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .config import SAMPLE_PROFILES

#: The fixed "now" of all queries on the test tables: 2024-01-31 00:00:00 UTC.
AS_OF = 1706659200
SOURCE_TYPES = ["rss", "github_releases", "web_changelog", "huggingface_models", "web_articles"]
ACTIONS = ["suggest_demo", "suggest_research_use", "suggest_internal_use_case", "suggest_teaching_use", "write_note"]


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


def _hours_before(hours):
    return as_of() - F.make_dt_interval(F.lit(0), hours.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; each twentieth has the URL of the one before it."""
    d = table(spark, sf_dir, "documents")
    number = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0))
    trust = (F.lit(30) + F.pmod(number * 13, F.lit(71))).cast("int")
    url_id = F.col("doc_id") - F.when(F.col("doc_id") % 20 == 19, 1).otherwise(0)
    return d.select(
        F.col("doc_id").alias("ordinal"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/feed")).alias("source_url"),
        trust.alias("source_trust"),
        (trust >= 80).alias("source_is_primary"),
        T.first_sentence(F.col("text")).alias("title"),
        F.concat(F.lit("https://News.example/"), url_id.cast("string"), F.lit("/?utm_source="), F.col("source"), F.lit("#top")).alias("url"),
        F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 97 != 0, _hours_before(F.col("doc_id") * 37 % 1440)).alias("published_at"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCE_TYPES]), (F.col("doc_id") % 5 + 1).cast("int")).alias("source_type"),
        F.lit(None).cast("string").alias("exact_model_id"),
    )


def normalized(candidates: DataFrame) -> DataFrame:
    """Candidates with cleaned title and summary, canonical_url, normalized_title, content_hash and discard_reason (invalid
    where there is no title or no http URL; else null). Map only."""
    clean = candidates.withColumns({"title": T.clean_title(F.col("title")), "summary": T.clean_summary(F.col("summary"))})
    clean = clean.withColumns({"normalized_title": T.normalized_title(F.col("title")), "canonical_url": T.canonical_url(F.col("url"))})
    web = F.startswith("canonical_url", F.lit("http://")) | F.startswith("canonical_url", F.lit("https://"))
    return clean.withColumns(
        {
            "content_hash": T.content_hash(F.col("summary"), F.col("normalized_title")),
            "discard_reason": F.when((F.col("normalized_title") == "") | ~web, "invalid"),
        }
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source of the candidates; one in seven is disabled."""
    c = candidates(spark, sf_dir)
    number = F.coalesce(F.regexp_extract("source_name", r"(\d+)", 1).try_cast("int"), F.lit(0))
    return c.groupBy("source_name", "source_url", "source_trust", "source_is_primary").agg(F.min("ordinal").alias("first")).select(
        F.col("source_name").alias("source_id"),
        F.col("source_name").alias("name"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCE_TYPES]), (number % 5 + 1).cast("int")).alias("source_type"),
        F.col("source_url").alias("base_url"),
        F.col("source_trust").alias("trust_level"),
        F.col("source_is_primary").alias("is_primary"),
        (number % 3 == 0).alias("requires_primary_verification"),
        (number % 7 != 6).alias("enabled"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as articles; the event is that of the normalized title."""
    c = candidates(spark, sf_dir).select("ordinal", "source_name", "title", "published_at", T.normalized_title(F.col("title")).alias("normalized_title"), "source_trust", "source_is_primary", "source_type", "summary")
    return c.select(
        F.col("ordinal").alias("article_id"),
        F.sha2("normalized_title", 256).alias("event_id"),
        F.col("source_name").alias("source_id"),
        F.concat(F.lit("https://news.example/"), F.col("ordinal").cast("string")).alias("canonical_url"),
        "title",
        "normalized_title",
        "published_at",
        _hours_before(F.col("ordinal") * 11 % 480).alias("discovered_at"),
        "source_trust",
        "source_is_primary",
        "source_type",
        F.substring("summary", 1, 200).alias("lead"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per normalized title; k is its smallest article id, from which the rest follows."""
    a = articles(spark, sf_dir)
    g = a.groupBy("event_id").agg(F.min("article_id").alias("k"), F.min_by("title", "article_id").alias("title"), F.min_by("normalized_title", "article_id").alias("normalized_title"), F.max("article_id").alias("last"))
    k = F.col("k")
    return g.select(
        "event_id",
        "k",
        "title",
        "normalized_title",
        F.when(k % 9 == 8, "discarded").when(k % 4 == 3, "pending").otherwise("analyzed").alias("status"),
        F.when(k % 9 == 8, F.when(k % 2 == 0, "analysis_failed").otherwise("low_relevance")).alias("event_discard_reason"),
        ((k * 7 % 101) / 100.0).alias("confidence"),
        F.when(k % 23 == 0, F.lit(0.95)).otherwise((k * 3 % 50) / 100.0).alias("hype"),
        (k % 3 == 0).alias("primary_source_verified"),
        _hours_before(k * 31 % 480 + 1).alias("first_seen_at"),
        _hours_before(F.col("last") * 17 % 240).alias("last_seen_at"),
        F.when(k % 9 != 8, (k % 360).cast("int")).alias("analyzed_run_no"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores per analyzed or discarded event."""
    e = events(spark, sf_dir).where("status <> 'pending'").select("event_id", "k")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("profile_id"), F.lit(slug).alias("slug"), F.lit(name).alias("name"), F.lit(on).alias("enabled")) for i, slug, name, _, on, _ in SAMPLE_PROFILES]))
    k, n = F.col("k"), F.col("profile_id")
    return e.select("event_id", "k", each.alias("p")).select("event_id", "k", "p.*").select(
        "event_id",
        "profile_id",
        "slug",
        "name",
        "enabled",
        ((k * 13 + n * 29) % 101).cast("int").alias("relevance_score"),
        ((k * 17 + n * 31) % 101).cast("int").alias("alert_score"),
        ((k * 19 + n * 37) % 101).cast("int").alias("actionability_score"),
        F.when((k + n) % 6 < 5, F.try_element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.pmod(k + n, F.lit(6)) + 1).cast("int"))).alias("suggested_action"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows of the events table as runs: counts, discards by type, tokens, start and end (none for one in 50)."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("tokens"), "user_id")
    run = (F.floor(F.unix_timestamp("ts") / 7200)).cast("long")
    return e.groupBy(run.alias("run_no")).agg(
        F.count("*").alias("collected"),
        F.count_if(F.col("event_type") == "purchase").alias("analyzed"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("tokens", F.lit(0)) % 7).alias("output_tokens"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_at"),
    ).select("*", F.when(F.col("run_no") % 50 != 7, F.col("last_at")).alias("finished_at"), F.when(F.col("run_no") % 50 == 7, "running").when(F.col("errors") > 8, "completed_with_errors").otherwise("completed").alias("status")).drop("last_at")


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found per user of the events table, as if users were sources; every seventh looks 60 days old."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id").agg(F.count("*").alias("items_found"), F.max("ts").alias("latest"))
    old = F.col("user_id") % 7 == 0
    return g.select(
        F.col("user_id").alias("source_no"),
        F.when(F.col("user_id") % 50 == 0, 503).otherwise(200).alias("http_status"),
        F.when(F.col("user_id") % 31 == 0, 0).otherwise(F.col("items_found")).alias("items_found"),
        F.when(old, F.col("latest") - F.expr("INTERVAL 60 DAYS")).otherwise(F.col("latest")).alias("latest_item_at"),
        (F.col("user_id") % 29 != 0).alias("valid"),
    )
