"""Which candidates go on: lookback, trust, phrases and weighted keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import config as C

#: Hours that a publication may lie back, and the least keyword score.
LOOKBACK_HOURS, MIN_SCORE = 48, 20
#: Fixed value: a patch release in a title.
PATCH_VERSION = r"\bv?\d+\.\d+\.[1-9]\d*\b"


def outside_lookback(published_at: Column, as_of: Column, hours: int = LOOKBACK_HOURS) -> Column:
    """Whether something was published before the lookback; not if its date is unknown."""
    return F.coalesce(published_at < as_of - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def safety_signal(title: Column, summary: Column) -> Column:
    """Whether an authority and a strategic safety phrase are both named."""
    text = F.replace(F.translate(F.lower(F.concat(title, F.lit(" "), summary)), "_", " "), F.lit("ß"), F.lit("ss"))
    return T.contains_any(text, C.SAFETY_SIGNALS) & T.contains_any(text, C.AUTHORITY_SIGNALS)


def with_keyword_score(candidates: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """candidates and keyword_score."""
    return candidates.withColumn("keyword_score", T.keyword_score(T.candidate_text(F.col("normalized_title"), F.col("summary")), terms))


def primary_bypass(min_score: int = MIN_SCORE) -> Column:
    """Whether a highly trusted primary source passes by a broad phrase in spite of a low keyword score."""
    text = T.candidate_text(F.col("normalized_title"), F.col("summary"))
    return (F.col("keyword_score") < min_score) & F.col("source_is_primary") & (F.col("source_trust") >= 95) & T.contains_any(text, C.BROAD_SIGNALS)


def prefilter_reason(as_of: Column, hours: int = LOOKBACK_HOURS, min_score: int = MIN_SCORE) -> Column:
    """Why a candidate is dropped, by the first rule that says so; null if it passes. Needs keyword_score."""
    text = T.candidate_text(F.col("normalized_title"), F.col("summary"))
    patch = F.rlike(F.lower("title"), F.lit(PATCH_VERSION))
    by_article = (F.col("source_type") == "web_articles") & T.contains_any(text, C.ARTICLE_SIGNALS)
    return (
        F.when(F.col("discard_reason").isNotNull(), F.col("discard_reason"))
        .when(F.col("published_at").isNull(), "invalid")
        .when(outside_lookback(F.col("published_at"), as_of, hours), "too_old")
        .when(F.col("source_trust") < 40, "low_trust")
        .when((F.col("source_type") == "web_changelog") & T.contains_any(text, C.LOW_VALUE_SIGNALS), "low_relevance")
        .when(
            (F.col("source_type") == "github_releases") & F.contains(F.lower("source_name"), F.lit("vllm")) & patch & ~T.contains_any(text, C.MAJOR_SIGNALS),
            "low_relevance",
        )
        .when((F.col("keyword_score") < min_score) & ~by_article & ~primary_bypass(min_score), "low_relevance")
    )


def prefiltered(candidates: DataFrame, terms: list[tuple[str, str]], as_of: Column, hours: int = LOOKBACK_HOURS, min_score: int = MIN_SCORE) -> DataFrame:
    """Normalized candidates with keyword_score, reason (null: passes) and primary_bypass. Map only."""
    scored = with_keyword_score(candidates, terms)
    return scored.withColumns({"reason": prefilter_reason(as_of, hours, min_score), "primary_bypass": primary_bypass(min_score)})
