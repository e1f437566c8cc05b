"""Lists, details and summaries over events, scores, runs and sources. Limits come before decorations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S

#: Days of current signals, rows of a page, days of the date buckets.
RECENT_DAYS, PAGE_ROWS = 7, 25
DATE_BUCKETS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "all": None}


def bucket_days(name: str | None) -> int | None:
    """Days of a date filter; unknown names mean 30 days, digits mean themselves, all means no filter."""
    if name in DATE_BUCKETS:
        return DATE_BUCKETS[name]
    return int(name) if name and name.isdigit() and int(name) > 0 else 30


def latest_articles(articles: DataFrame) -> DataFrame:
    """Each event's latest article: by publication, unknown dates last, then by discovery and id."""
    order = F.struct(F.col("published_at").isNotNull().alias("a"), "published_at", F.col("discovered_at").alias("d"), F.col("article_id").alias("i"))
    best = articles.groupBy("event_id").agg(F.max_by(F.struct("article_id", "source_id", "canonical_url", "title", "published_at"), order).alias("x"))
    return best.select("event_id", F.col("x.article_id").alias("article_id"), F.col("x.source_id").alias("source_id"), F.col("x.canonical_url").alias("canonical_url"), F.col("x.published_at").alias("published_at"))


def badges(scores: DataFrame, per_event: int = 3) -> DataFrame:
    """The enabled profiles with the highest alert scores of each event, with their place."""
    order = W.partitionBy("event_id").orderBy(F.desc("alert_score"), "profile_id")
    return scores.where("enabled").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_event).select("event_id", "place", "slug", "alert_score")


def event_maxima(scores: DataFrame) -> DataFrame:
    return scores.groupBy("event_id").agg(
        F.max("alert_score").alias("max_alert"), F.max("relevance_score").alias("max_relevance"), F.max("actionability_score").alias("max_actionability")
    )


def high_signal(events: DataFrame, scores: DataFrame, articles: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """The analyzed events with the highest alert scores among those with recent articles. Scores and articles are summed up
    apart, so that they do not multiply; the top profile may be disabled."""
    top = F.max_by("name", F.struct("alert_score", (-F.col("profile_id")).alias("p")))
    by_score = scores.groupBy("event_id").agg(F.max("alert_score").alias("max_alert"), top.alias("top_profile"))
    by_article = articles.groupBy("event_id").agg(F.max("published_at").alias("published_at"))
    recency = F.coalesce("published_at", "first_seen_at")
    rows = events.where("status = 'analyzed'").join(by_score, "event_id").join(by_article, "event_id")
    rows = rows.withColumn("recency_at", recency).where(F.col("recency_at") >= as_of - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
    return rows.orderBy(F.desc("max_alert"), F.desc("recency_at"), "event_id").limit(limit).select("event_id", "title", "max_alert", "top_profile", "recency_at")


def filtered_events(events: DataFrame, articles: DataFrame, scores: DataFrame, as_of: Column, search: str | None = None, primary: bool | None = None, days: int | None = None, source_id: str | None = None, min_relevance: int | None = None, min_alert: int | None = None, profile: str | None = None) -> DataFrame:
    """Analyzed events that pass all given filters; those on articles and scores are semi-joins, on one and the same score row."""
    rows = events.where("status = 'analyzed'")
    if search:
        rows = rows.where(F.ilike("title", F.lit(f"%{search}%")))
    if primary is not None:
        rows = rows.where(F.col("primary_source_verified") == primary)
    if days:
        rows = rows.join(articles.where(F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).select("event_id"), "event_id", "left_semi")
    if source_id:
        rows = rows.join(articles.where(F.col("source_id") == source_id).select("event_id"), "event_id", "left_semi")
    if min_relevance is not None or min_alert is not None or profile:
        s = scores.where("enabled")
        s = s.where(F.col("relevance_score") >= min_relevance) if min_relevance is not None else s
        s = s.where(F.col("alert_score") >= min_alert) if min_alert is not None else s
        s = s.where(F.col("slug") == profile) if profile else s
        rows = rows.join(s.select("event_id"), "event_id", "left_semi")
    return rows


def event_list(filtered: DataFrame, scores: DataFrame, articles: DataFrame, as_of: Column, page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """One page of events by last_seen_at, with latest article, maxima over enabled profiles, recency and the mark of old ones."""
    shown = filtered.orderBy(F.desc("last_seen_at"), "event_id").offset((page - 1) * rows).limit(rows)
    keys = F.broadcast(shown.select("event_id"))  # one page of ids
    latest = latest_articles(articles.join(keys, "event_id", "left_semi"))
    best = event_maxima(scores.where("enabled").join(keys, "event_id", "left_semi"))
    out = shown.join(latest, "event_id", "left").join(best, "event_id", "left")
    recency = F.coalesce("published_at", "first_seen_at")
    return out.select(
        "event_id", "title", "last_seen_at", "source_id", "canonical_url",
        F.coalesce("max_alert", F.lit(0)).alias("max_alert"), F.coalesce("max_relevance", F.lit(0)).alias("max_relevance"),
        recency.alias("recency_at"), S.is_historical(recency, as_of).alias("historical"), S.relative_time(recency, as_of).alias("ago"),
    )


def event_detail(events: DataFrame, scores: DataFrame, articles: DataFrame) -> DataFrame:
    """All events with their scores and articles as sorted lists (text), and the best primary article's URL."""
    from ..operators.evidence import best_primary

    entry = F.concat_ws(":", "slug", F.col("alert_score").cast("string"))
    s = scores.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("scores"))
    a = articles.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("article_id")), lambda i: i.cast("string")), ",").alias("articles"), F.count("*").alias("n_articles"))
    return events.join(a, "event_id").join(s, "event_id", "left").join(best_primary(articles), "event_id", "left").select("event_id", "title", "status", "scores", "articles", "n_articles", "primary_source_url")


def source_stats(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_id").agg(F.count("*").alias("items"), F.max("discovered_at").alias("last_discovered"), F.max("published_at").alias("last_published"))


def sources_report(sources: DataFrame, health: DataFrame, stats: DataFrame) -> DataFrame:
    """Sources by type and name with their health (UNKNOWN if never checked) and latest items."""
    out = sources.join(health.select("source_id", F.col("status").alias("health")), "source_id", "left").join(stats, "source_id", "left")
    return out.select("source_id", "source_type", "name", "enabled", F.coalesce("health", F.lit("UNKNOWN")).alias("health"), "last_discovered", "last_published").orderBy("source_type", "name")


def health_summary(sources: DataFrame, health: DataFrame) -> DataFrame:
    """One row: enabled sources in all, healthy, stale, failing and never checked."""
    j = sources.where("enabled").join(health.select("source_id", "status"), "source_id", "left")
    ok, stale, none = F.col("status") == "OK", F.col("status") == "STALE", F.col("status").isNull()
    return j.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("healthy"), F.count_if(stale).alias("stale"), F.count_if(~ok & ~stale).alias("error"), F.count_if(none).alias("unknown")
    )


def system_state(summary: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Component and state (0 ok, 1 warning, 2 error) of sources and the last run, and the worst of them."""
    src = summary.select(F.lit("sources").alias("component"), F.when(F.col("total") == 0, 1).when(F.col("error") > 0, 2).when((F.col("stale") > 0) | (F.col("unknown") > 0), 1).otherwise(0).alias("state"))
    last = runs.agg(F.max_by(F.struct("status", "started_at", "finished_at"), "started_at").alias("r"))
    age, run = lambda c, n: c < as_of - F.expr(f"INTERVAL {n} HOURS"), F.col("r")
    state = (
        F.when(run.isNull(), 1).when(run["status"] == "completed_with_errors", 1).when(run["finished_at"].isNull() & age(run["started_at"], 1), 2)
        .when(run["finished_at"].isNull(), 0).when(age(run["finished_at"], 6), 1).otherwise(0)
    )
    both = src.unionByName(last.select(F.lit("last run").alias("component"), state.alias("state")))
    return both.unionByName(both.agg(F.lit("overall").alias("component"), F.max("state").alias("state")))


def run_list(runs: DataFrame, page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_no").offset((page - 1) * rows).limit(rows).withColumn("seconds", S.duration_seconds(F.col("started_at"), F.col("finished_at")))


def run_events(runs: DataFrame, events: DataFrame, scores: DataFrame, run_no: int, limit: int | None = None) -> DataFrame:
    """A run's events: those it analyzed and, for a finished run, those without a run whose scores fall into its time; by
    maximum alert and relevance, then title. The two cases are joined apart, not by a condition with or."""
    run = runs.where(F.col("run_no") == run_no)
    own = events.where(F.col("analyzed_run_no") == run_no)
    done = F.broadcast(run.where("finished_at is not null").select("started_at", "finished_at"))  # one row
    stray = events.where("analyzed_run_no is null").join(done, F.col("last_seen_at").between(F.col("started_at"), F.col("finished_at")), "left_semi")
    found = own.unionByName(stray).dropDuplicates(["event_id"])
    out = found.join(event_maxima(scores), "event_id", "left").select("event_id", "title", "status", "max_alert", "max_relevance")
    out = out.orderBy(F.desc_nulls_last("max_alert"), F.desc_nulls_last("max_relevance"), "title", "event_id")
    return out.limit(limit) if limit else out


def run_detail(events: DataFrame, run_no: int) -> DataFrame:
    """The events that a run analyzed, those seen last first; event_id decides between equals."""
    return events.where(F.col("analyzed_run_no") == run_no).orderBy(F.desc_nulls_last("last_seen_at"), "event_id")


def lineage(records: DataFrame, articles: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Every record (ordinal, article_id, source_name, decision) with its article, event and source, as far as there are any."""
    a = articles.select("article_id", "event_id", F.col("canonical_url").alias("article_url"), "source_id")
    out = records.join(a, "article_id", "left").join(events.select("event_id", F.col("title").alias("event_title"), F.col("status").alias("event_status")), "event_id", "left")
    out = out.join(sources.select("source_id", "trust_level", "source_type"), "source_id", "left")
    return out.select("ordinal", "article_id", "event_id", "decision", F.coalesce("article_url", F.lit("")).alias("article_url"), F.coalesce("event_status", F.lit("none")).alias("event_status"), F.coalesce("source_id", "source_name").alias("source"), "trust_level")


def run_summary(decisions: DataFrame) -> DataFrame:
    """Discards as a map, and the counters of a run, one row per run_no of decisions (decision, source_type, primary_bypass)."""
    kept = F.col("decision").isin("analyze", "pending_reanalysis", "evidence_reanalysis")
    counts = decisions.groupBy("run_no", "decision").agg(
        F.count("*").alias("n"), F.count_if(F.col("primary_bypass")).alias("bypass"), F.count_if(F.col("source_type") == "web_articles").alias("web")
    )
    n = F.col("n")
    return counts.groupBy("run_no").agg(
        F.sum("n").alias("collected"),
        F.sum(F.when(F.col("decision") == "analyze", n).otherwise(0)).alias("prefilter_passed"),
        F.sum(F.when(F.col("decision") == "analyze", F.col("bypass")).otherwise(0)).alias("primary_bypass_passed"),
        F.sum(F.when(F.col("decision") == "pending_reanalysis", n).otherwise(0)).alias("pending_reanalysis"),
        F.sum(F.when(F.col("decision") == "evidence_reanalysis", n).otherwise(0)).alias("evidence_reanalysis"),
        F.sum("web").alias("web_articles"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~kept, F.struct("decision", "n"))))).alias("discards"),
    )
