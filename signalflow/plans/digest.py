"""The digest of a period: ranked events, counts, suggested actions, message texts and their packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..sources.config import ACTION_LABELS
from .reports import event_maxima

HOURS, ITEMS, MIN_ALERT, ACTIONS, MESSAGE_CHARS = 24, 10, 60, 3, 3800
#: Fixed value: what stands between two blocks of a message.
SEPARATOR = "\n\n━━━━━━━━━━━━━━━━━━\n\n"


def action_label(action: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_LABELS.items() for x in kv]), action), action)


def period_events(events: DataFrame, scores: DataFrame, articles: DataFrame, alerts: DataFrame, as_of: Column, hours: int = HOURS, run_no: int | None = None) -> DataFrame:
    """Events of the last hours (by the dates of their articles), or those a run analyzed, that enabled profiles have scored:
    maxima, latest article of the period, and whether an alert went out before. Any status."""
    date = S.effective_date(F.col("published_at"), F.col("discovered_at"))
    inside = articles.withColumn("date", date)
    if run_no is None:
        inside = inside.where((F.col("date") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("date") <= as_of))
    else:
        inside = inside.join(events.where(F.col("analyzed_run_no") == run_no).select("event_id"), "event_id", "left_semi")
    latest = inside.groupBy("event_id").agg(F.max_by(F.struct("article_id", "canonical_url", "source_id", "date"), F.struct("date", "article_id")).alias("a"))
    best = event_maxima(scores.where("enabled"))
    sent = alerts.where("alert_type = 'immediate' and delivery_status = 'sent'").select("event_id", F.lit(True).alias("sent")).distinct()
    out = events.join(latest, "event_id").join(best, "event_id").join(sent, "event_id", "left")
    return out.select("event_id", "title", "max_alert", "max_relevance", "max_actionability", F.col("a.date").alias("recency_at"), F.col("a.canonical_url").alias("canonical_url"), F.coalesce("sent", F.lit(False)).alias("alerted_before"))


def ranked(period: DataFrame, items: int = ITEMS, min_alert: int = MIN_ALERT) -> DataFrame:
    """The top events by alert, relevance, actionability and recency, with their category."""
    top = period.where(F.col("max_alert") >= min_alert).orderBy(F.desc("max_alert"), F.desc("max_relevance"), F.desc("max_actionability"), F.desc("recency_at"), "event_id").limit(items)
    return top.withColumn("category", S.category(F.col("max_alert")))


def category_counts(top: DataFrame) -> DataFrame:
    return top.groupBy("category").agg(F.count("*").alias("n"))


def profile_counts(top: DataFrame, scores: DataFrame) -> DataFrame:
    """Per enabled profile, the selected events that matter to it; profiles without any are left out."""
    s = scores.where("enabled and (relevance_score >= 50 or alert_score >= 50)")
    return s.join(top.select("event_id"), "event_id").groupBy("name").agg(F.count("*").alias("n")).orderBy("name")


def top_actions(top: DataFrame, scores: DataFrame, actions: int = ACTIONS) -> DataFrame:
    """The suggested actions with the highest actionability, each label once."""
    s = scores.where("enabled and suggested_action is not null").join(top.select("event_id"), "event_id")
    g = s.groupBy(action_label(F.col("suggested_action")).alias("label")).agg(F.max("actionability_score").alias("actionability"))
    return g.orderBy(F.desc("actionability"), "label").limit(actions)


def best_action(scores: DataFrame) -> DataFrame:
    """Each event's suggested action of the highest actionability, the first profile's on a tie."""
    s = scores.where("enabled").groupBy("event_id").agg(F.max_by("suggested_action", F.struct("actionability_score", (-F.col("profile_id")).alias("p"))).alias("action"))
    return s.select("event_id", action_label(F.col("action")).alias("action"))


def blocks(top: DataFrame, scores: DataFrame) -> DataFrame:
    """One text block per selected event, with its place."""
    # top has a digest's few events, so one task numbers them.
    place = F.row_number().over(Window.orderBy(F.desc("max_alert"), F.desc("max_relevance"), F.desc("max_actionability"), F.desc("recency_at"), "event_id"))
    rows = top.select(place.alias("place"), "event_id", "title", "category", "canonical_url", "alerted_before").join(best_action(scores), "event_id", "left")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), F.col("place").cast("string"), F.lit(". "), T.html_escape(F.col("title")), F.lit("</b>")),
        "category",
        F.when(F.col("alerted_before"), "alerted before"),
        F.col("action"),
        F.concat(F.lit('<a href="'), T.html_escape(F.col("canonical_url")), F.lit('">source</a>')),
    )
    return rows.select("place", text.alias("text"))


def pack_blocks(texts: list[str], limit: int = MESSAGE_CHARS) -> list[str]:
    """Messages of at most limit characters: blocks in order, joined by the separator; longer blocks are split by line and
    longer lines by word, of which none may be longer than a message."""
    room = limit - 50
    pieces: list[str] = []
    for text in texts:
        held = None
        for line in text.splitlines() if len(text) > room else [text]:
            units = [(line, "\n")] if len(line) <= room else [(w, " " if i else "\n") for i, w in enumerate(line.split(" "))]
            for unit, glue in units:
                if len(unit) > room:
                    raise ValueError("a word is longer than a message")
                # A long line starts a piece of its own.
                if held is not None and len(held + glue + unit) <= room and not (len(line) > room and glue == "\n"):
                    held = held + glue + unit
                else:
                    if held:
                        pieces.append(held)
                    held = unit
        if held:
            pieces.append(held)
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1] + SEPARATOR + piece) <= room:
            out[-1] += SEPARATOR + piece
        else:
            out.append(piece)
    return [f"<b>DIGEST{f' ({i}/{len(out)})' if len(out) > 1 else ''}</b>\n\n{m}" for i, m in enumerate(out, 1)]


def messages(blocks: DataFrame, limit: int = MESSAGE_CHARS) -> DataFrame:
    """digest_id, part and text: the blocks (digest_id, place, text) of each digest packed into messages."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        parts = pack_blocks(group.sort_values("place")["text"].tolist(), limit)
        return pd.DataFrame({"digest_id": [group["digest_id"].iloc[0]] * len(parts), "part": range(1, len(parts) + 1), "text": parts})

    return blocks.groupBy("digest_id").applyInPandas(pack, "digest_id string, part int, text string")


def reserved(messages: DataFrame, digests: DataFrame, as_of: Column, hours: int = HOURS) -> DataFrame:
    """A digest row with its idempotency key, unless one with that key is pending or sent."""
    body = messages.groupBy("digest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("body"))
    row = body.select("digest_id", F.sha2("body", 256).alias("content_hash")).withColumn("idempotency_key", F.sha2(F.concat_ws("|", S.period_key(hours, as_of), "content_hash"), 256))
    known = digests.where("status in ('pending', 'sent')").select("idempotency_key")
    return row.join(known, "idempotency_key", "left_anti").withColumn("status", F.lit("pending"))
