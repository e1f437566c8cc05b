"""Alerts: the message of an event with its scores, and the log of decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .digest import action_label

#: The parts of an alert's message and the names of its sources, in the language of the readers.
HAPPENED, MATTERS, REASONS, ACTIONS, NO_ACTION = "WHAT HAPPENED", "WHY IT MATTERS", "REASONS", "SUGGESTED ACTION", "No action suggested."
PRIMARY, UNVERIFIED, SECONDARY = "Primary source: yes", "Secondary source, to be verified by a primary one", "Primary source: no"


def source_label(is_primary: Column, requires_primary: Column) -> Column:
    return F.when(is_primary, PRIMARY).when(requires_primary, UNVERIFIED).otherwise(SECONDARY)


def alert_messages(events: DataFrame, scores: DataFrame) -> DataFrame:
    """event_id and text: the HTML message of each event's alert.

    events: event_id, title, confidence, hype, source_is_primary, source_requires_primary, canonical_url, what_happened,
    why_it_matters. scores, a row per event and enabled profile: event_id, profile_id, icon, name, relevance_score, alert_score,
    suggested_action, reason. The message has the highest score, title, confidence, hype and kind of source; a line for each
    profile by falling score; what happened and why it matters; and reasons and actions in the profiles' order. Texts are
    escaped; nulls in texts are empty; events without scores have no message.
    """
    text = lambda c: T.html_escape(F.coalesce(c, F.lit("")))
    each = F.struct("profile_id", "icon", "name", "relevance_score", "alert_score", "suggested_action", "reason")
    by_profile = scores.groupBy("event_id").agg(F.array_sort(F.collect_list(each)).alias("own"), F.array_sort(F.collect_list(F.struct((-F.col("alert_score")).alias("s"), each.alias("p")))).alias("falling"))
    named = lambda p: F.concat(F.coalesce(p["icon"], F.lit("")), F.lit(" <b>"), text(p["name"]), F.lit("</b>"))
    lines = F.transform("falling", lambda x: F.concat(named(x["p"]), F.lit("\nRelevance: "), x["p"]["relevance_score"].cast("string"), F.lit("\nAlert: "), x["p"]["alert_score"].cast("string")))
    acting = F.filter("own", lambda p: F.coalesce(p["suggested_action"], F.lit("")) != "")
    actions = F.array_join(F.transform(acting, lambda p: F.concat(named(p), F.lit(": "), text(action_label(p["suggested_action"])))), "\n")
    reasons = F.array_join(F.transform("own", lambda p: F.concat(F.lit("• "), text(p["name"]), F.lit(": "), text(p["reason"]))), "\n")
    part = lambda name, body: F.concat(F.lit(f"<b>{name}</b>\n"), body)
    top = F.concat(F.lit("<b>ALERT "), F.array_max(F.transform("own", lambda p: p["alert_score"])).cast("string"), F.lit("/100</b>"))
    about = F.concat_ws(
        "\n", F.concat(F.lit("<b>"), text(F.col("title")), F.lit("</b>")), F.concat(F.lit("Confidence: "), F.format_number("confidence", 2)), F.concat(F.lit("Hype: "), F.format_number("hype", 2)),
        source_label(F.col("source_is_primary"), F.col("source_requires_primary")),
    )
    message = F.concat_ws(
        "\n\n", top, about, F.array_join(lines, "\n\n"), part(HAPPENED, text(F.col("what_happened"))), part(MATTERS, text(F.col("why_it_matters"))), part(REASONS, reasons),
        part(ACTIONS, F.when(actions == "", NO_ACTION).otherwise(actions)), F.concat(F.lit('<a href="'), text(F.col("canonical_url")), F.lit('">Source</a>')),
    )
    return events.join(by_profile, "event_id").select("event_id", message.alias("text"))


def append_decisions(decisions: DataFrame, path: str, decided_at: Column) -> None:
    """Append decisions to the log under path, partitioned by day. A run that is repeated appends again; runs.write_log replaces
    instead."""
    log = decisions.withColumn("decided_at", decided_at).withColumn("day", F.to_date("decided_at"))
    log.write.mode("append").partitionBy("day").parquet(path)


def analyzed(requests: DataFrame, analyzer: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Responses of a pluggable analyzer (a function from requests to responses: event_id, usage, content), parsed; requests that it
    does not answer come back with error no_response, so that they stay pending."""
    answers = parse(analyzer(requests))
    out = requests.select("event_id").join(answers, "event_id", "left")
    return out.withColumn("error", F.when(F.col("analysis").isNull() & F.col("error").isNull(), "no_response").otherwise(F.col("error")))
