"""Analyses: requests to and responses from an external analyzer, their validation, scores and the alert outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..schemas import ANALYSIS

ALERT_THRESHOLD, SAFETY_THRESHOLD, ALERT_CONFIDENCE, MAX_HYPE = 90, 80, 0.75, 0.9
#: Fixed value: a percent-encoded byte, which generated text must not have.
_ENCODED_BYTE = "%[0-9a-fA-F]{2}"


def requests(candidates: DataFrame, profiles: list[tuple]) -> DataFrame:
    """event_id and payload (JSON): the article's fields, the enabled profiles and their closed class lists."""
    closed = [F.struct(F.lit(slug).alias("slug"), F.lit(name).alias("name"), F.array(*[F.lit(c) for c in classes]).alias("classes")) for _, slug, name, _, on, classes in profiles if on]
    article = F.struct("title", "summary", "source_name", "published_at")
    return candidates.select("event_id", F.to_json(F.struct(article.alias("article"), F.array(*closed).alias("profiles"))).alias("payload"))


def parsed(responses: DataFrame) -> DataFrame:
    """responses (event_id, usage, content: JSON texts) with input_tokens, output_tokens, analysis and error (analysis_failed
    where content is no analysis). Usage may spell its counts in either of two ways."""
    usage = F.from_json("usage", "prompt_tokens long, completion_tokens long, input_tokens long, output_tokens long")
    got = responses.withColumns({"_u": usage, "analysis": F.from_json("content", ANALYSIS)})
    bad = F.col("analysis").isNull() | F.col("analysis.subject_name").isNull() | F.col("analysis.profiles").isNull()
    return got.select(
        "event_id",
        F.coalesce("_u.prompt_tokens", "_u.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("_u.completion_tokens", "_u.output_tokens", F.lit(0)).alias("output_tokens"),
        F.when(~bad, F.col("analysis")).alias("analysis"),
        F.when(bad, "analysis_failed").alias("error"),
    )


def invalid_reason(a: Column, profile_slugs: list[str]) -> Column:
    """Why an analysis is rejected: a score out of range, percent-encoded text, or another set of profiles; null if it is not."""
    share = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    score = lambda x: F.coalesce(x.between(0, 100), F.lit(False))
    names = ("relevance_score", "novelty_score", "actionability_score", "strategic_impact_score", "alert_score")

    def all_scores(p: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & score(p[n])
        return out

    ranges = score(a["novelty_score"]) & score(a["credibility_score"]) & share(a["confidence"]) & share(a["hype_probability"]) & F.forall(a["profiles"], all_scores)
    texts = F.concat_ws(" ", *[a[n] for n in ("subject_name", "subject_type", "summary", "what_happened", "why_it_matters", "what_changed")])
    per_profile = F.array_join(F.transform(a["profiles"], lambda p: F.concat_ws(" ", p["reason"], p["suggested_action"])), " ")
    got = F.transform(a["profiles"], lambda p: p["profile"])
    expected = F.array(*[F.lit(s) for s in sorted(profile_slugs)])
    return (
        F.when(a.isNull(), "analysis_failed").when(~ranges, "out_of_range")
        .when(F.rlike(texts, F.lit(_ENCODED_BYTE)) | F.rlike(per_profile, F.lit(_ENCODED_BYTE)), "encoded_text")
        .when((F.size(got) != F.size(F.array_distinct(got))) | (F.array_sort(got) != expected), "profile_set")
    )


def analysis_text(a: Column) -> Column:
    """All generated text of an analysis, one piece per line."""
    first = [F.coalesce(a[n], F.lit("")) for n in ("subject_name", "what_happened", "why_it_matters", "what_changed")]
    per_profile = F.flatten(F.transform(a["profiles"], lambda p: F.array(p["reason"], F.coalesce(p["suggested_action"], F.lit("")), F.array_join(p["related_topics"], " "))))
    return F.array_join(F.concat(F.array(*first), per_profile), "\n")


def anchor_contradictions(title: Column, summary: Column, model_id: Column, subject: Column, text: Column) -> Column:
    """Product identifiers that generated text names and its source does not; one entry subject:... where the subject is not
    the exact model. Empty where nothing is wrong, and where the source names no identifier at all."""
    allowed = F.array_distinct(F.concat(T.identifiers(F.concat_ws("\n", title, summary)), F.when(model_id.isNotNull(), F.array(T.anchor(model_id))).otherwise(F.array().cast("array<string>"))))
    extra = F.array_sort(F.array_except(T.identifiers(text), allowed))
    wrong = model_id.isNotNull() & (T.anchor(F.coalesce(subject, F.lit(""))) != T.anchor(model_id))
    none = F.array().cast("array<string>")
    return F.concat(F.when(wrong, F.array(F.concat(F.lit("subject:"), T.anchor(F.coalesce(subject, F.lit("")))))).otherwise(none), F.when(F.size(allowed) > 0, extra).otherwise(none))


def closed_classes(evaluations: DataFrame, profiles: DataFrame) -> DataFrame:
    """evaluations (slug, related_classes, ...) with valid_classes, in their order, and invalid_classes, by the profile's list."""
    allowed = profiles.select("slug", F.col("class_ids").alias("_allowed"))
    joined = evaluations.join(F.broadcast(allowed), "slug", "left")
    ok = lambda c: F.array_contains(F.coalesce("_allowed", F.array().cast("array<int>")), c)
    return joined.withColumns({"valid_classes": F.filter("related_classes", ok), "invalid_classes": F.filter("related_classes", lambda c: ~ok(c))}).drop("_allowed")


def scored(evaluations: DataFrame) -> DataFrame:
    """evaluations (alert_score, confidence, source_trust, source_is_primary, hype, ...) with final_alert and category."""
    final = S.alert_score(F.col("alert_score"), F.col("confidence"), F.col("source_trust"), F.col("source_is_primary"), F.col("hype"))
    return evaluations.withColumn("final_alert", final).withColumn("category", S.category(F.col("final_alert")))


def outcome(events: DataFrame) -> DataFrame:
    """events (max_alert, hype, confidence, is_safety, ...) with threshold, high_hype (to be discarded) and alerts (to be sent)."""
    threshold = F.when(F.col("is_safety"), min(ALERT_THRESHOLD, SAFETY_THRESHOLD)).otherwise(ALERT_THRESHOLD)
    e = events.withColumn("threshold", threshold)
    return e.withColumns(
        {
            "high_hype": (F.col("hype") >= MAX_HYPE) & (F.col("max_alert") < F.col("threshold")),
            "alerts": (F.col("max_alert") >= F.col("threshold")) & (F.col("confidence") >= ALERT_CONFIDENCE),
        }
    )


def reserve_alerts(due: DataFrame, alerts: DataFrame, alert_type: str = "immediate", channel: str = "telegram") -> DataFrame:
    """New outbox rows, status pending, for due events (event_id, text) that have none of this type and channel. The key is
    fixed by event, type and channel, so a repeated batch reserves the same rows."""
    known = alerts.where((F.col("alert_type") == alert_type) & (F.col("channel") == channel)).select("event_id")
    new = due.dropDuplicates(["event_id"]).join(known, "event_id", "left_anti")
    return new.select(
        F.sha2(F.concat_ws("|", "event_id", F.lit(alert_type), F.lit(channel)), 256).alias("alert_id"),
        "event_id", F.lit(alert_type).alias("alert_type"), F.lit(channel).alias("channel"), F.sha2("text", 256).alias("content_fingerprint"), "text", F.lit("pending").alias("delivery_status"),
    )


def delivered(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """alerts with delivery_status from outcomes (alert_id, sent boolean) where there is one."""
    got = outcomes.groupBy("alert_id").agg(F.max("sent").alias("_sent"))
    status = F.when(F.col("_sent").isNull(), F.col("delivery_status")).when(F.col("_sent"), "sent").otherwise("failed")
    return alerts.join(got, "alert_id", "left").withColumn("delivery_status", status).drop("_sent")


def within_call_cap(queue: DataFrame, cap: int = 50) -> DataFrame:
    """The first cap events of a run by ordinal; the others stay pending."""
    return queue.orderBy("ordinal").limit(cap)
