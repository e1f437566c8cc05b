"""Which candidates belong to which event, what evidence they add, and what becomes of each: resolution and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .prefilter import outside_lookback
from .similarity import MIN_RATIO, leaders, title_groups, title_pairs
from .tables import saved

#: How far a source type is preferred as primary source.
TYPE_PRIORITY = {"web_changelog": 50, "rss": 45, "web_articles": 40, "github_releases": 30, "huggingface_models": 30}
#: Summaries from this length on identify an event by their content; days that events take new titles.
MIN_CONTENT, MATCH_DAYS = 40, 14

#: Decisions that mark no candidate, article or event as discarded.
UNMARKED = ("already_seen", "duplicate", "analyze", "pending_reanalysis", "evidence_reanalysis")


def type_priority(source_type: Column) -> Column:
    out = F.lit(0)
    for name, rank in TYPE_PRIORITY.items():
        out = F.when(source_type == name, rank).otherwise(out)
    return out


def already_seen(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """candidates with seen_article: the article of the same canonical URL, stored before or the first of this batch; null
    for the first of a URL that is new."""
    urls = candidates.groupBy(F.col("canonical_url").alias("_url")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n"))
    known = articles.groupBy(F.col("canonical_url").alias("_known_url")).agg(F.min("article_id").alias("_known"))
    # Only URLs that say something meet the whole rows; a URL that many rows share is one row here.
    told = urls.join(known, F.col("_url") == F.col("_known_url"), "left").where("_n > 1 or _known is not null").select("_url", "_first", "_known")
    joined = candidates.join(told, F.col("canonical_url").eqNullSafe(F.col("_url")), "left")
    seen = F.coalesce("_known", F.when(F.col("ordinal") > F.col("_first"), F.col("_first")))
    return joined.withColumn("seen_article", seen).drop("_first", "_url", "_known")


def content_groups(candidates: DataFrame) -> DataFrame:
    """candidates with content_first: the first ordinal of the same content, for summaries long enough to tell; else their
    own. Shorter summaries are not grouped, and contents are counted before they meet the rows, so boilerplate makes no hot group."""
    told = F.length("summary") >= MIN_CONTENT
    groups = candidates.where(told).groupBy(F.col("content_hash").alias("_hash")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = candidates.join(groups.select("_hash", "_first"), told & (F.col("content_hash") == F.col("_hash")), "left")
    return joined.withColumn("content_first", F.coalesce("_first", "ordinal")).drop("_hash", "_first")


def resolve_events(candidates: DataFrame, stored: DataFrame, as_of: Column, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Each new candidate's event.

    candidates: normalized, one per canonical URL, with ordinal (order of arrival). stored: events (event_no: smaller than
    any ordinal's, e.g. negative; event_id, title, normalized_title, subject_name, first_seen_at, content_hashes). In this order a
    candidate joins the event of equal content (without a time limit), of the same model identity, or of a similar title
    (both for events first seen in the last MATCH_DAYS days); else it leads a new event. Titles are compared with the title
    that an event began with, so clusters have leaders and do not chain. Where several events match, the earliest counts.
    Returns ordinal, leader (event_no of a stored event or the ordinal of the leading candidate), event_id, is_new_event
    and by (content, model, title or new).
    """
    c = saved(content_groups(candidates).select("ordinal", "content_first", "content_hash", "normalized_title", "title", "exact_model_id", F.length("summary").alias("_n")), "candidates")
    hashes = stored.select(F.col("event_no").alias("content_event"), F.explode("content_hashes").alias("content_hash")).groupBy("content_hash").agg(F.min("content_event").alias("content_event"))
    first = c.where(F.col("ordinal") == F.col("content_first")).join(hashes, "content_hash", "left").withColumn("content_event", F.when(F.col("_n") >= MIN_CONTENT, F.col("content_event")))
    first = saved(first, "content-firsts")
    live = stored.where(F.col("first_seen_at") >= as_of - F.expr(f"INTERVAL {MATCH_DAYS} DAYS"))
    stored_model = live.select(F.col("event_no").alias("a"), T.model_identity(F.coalesce(F.nullif("subject_name", F.lit("")), "title")).alias("model"))
    # Candidates of one title, one own model and one model of their title do the same, so the first of them stands for all.
    items = first.where("content_event is null").select(
        "ordinal", F.col("normalized_title").alias("name"), F.coalesce("normalized_title", F.concat(F.lit("#"), F.col("ordinal").cast("string"))).alias("kind"),
        F.when(F.col("exact_model_id").isNotNull(), T.model_identity(F.col("exact_model_id"))).alias("own"), T.model_identity(F.col("title")).alias("model"),
    )
    classes = saved(items.groupBy("kind", "own", "model").agg(F.min("ordinal").alias("id"), F.first("name").alias("name")), "candidate-classes")
    named = classes.select("id", F.col("name").alias("title")).unionByName(title_groups(live.select(F.col("event_no").alias("id"), F.col("normalized_title").alias("title"))).withColumnRenamed("rep", "id"))
    named = saved(named.where("title is not null"), "class-titles")
    groups = saved(title_groups(named), "class-groups")
    member = named.join(groups, "title").select("id", "rep")
    by_title = title_pairs(groups, min_ratio).select("rep", "rep2").unionByName(groups.select("rep", F.col("rep").alias("rep2")))
    across = by_title.join(member.withColumnRenamed("id", "x"), "rep").join(member.select(F.col("id").alias("y"), F.col("rep").alias("rep2")), "rep2").where("x <> y")
    # Stored events do not join each other; of those of one model only the first can lead.
    pairs = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("b >= 0")
    first_stored = stored_model.where("model is not null").groupBy("model").agg(F.min("a").alias("a"))
    targets = first_stored.unionByName(classes.where("model is not null").select("model", F.col("id").alias("a")))
    same_model = classes.where("own is not null").select(F.col("id").alias("b"), F.col("own").alias("model")).join(targets, "model").where("a < b").select("a", "b")
    nodes = classes.select("id").unionByName(named.where("id < 0").select("id")).unionByName(first_stored.select(F.col("a").alias("id"))).distinct()
    led = saved(leaders(nodes, pairs.unionByName(same_model)), "led-classes")
    heads = led.where("id = leader").join(classes.select("id", "model"), "id").select("model", F.col("id").alias("a"))
    model_head = first_stored.unionByName(heads.where("model is not null")).groupBy("model").agg(F.min("a").alias("head"))
    classed = classes.join(led, "id").join(model_head.withColumnRenamed("model", "own"), "own", "left").select("kind", "own", "model", "leader", "id", "head")
    same_class = (items["kind"] == classed["kind"]) & items["own"].eqNullSafe(classed["own"]) & items["model"].eqNullSafe(classed["model"])
    led_items = items.join(classed, same_class).select(
        F.col("ordinal").alias("_item"), F.col("leader").alias("leader"), F.when(F.col("head") < F.col("ordinal"), F.col("head")).alias("model_leader")
    )
    placed = first.join(led_items, F.col("ordinal") == F.col("_item"), "left")
    leader = F.coalesce("content_event", F.when(F.col("leader") != F.col("ordinal"), F.coalesce("model_leader", "leader")), "ordinal")
    by = F.when(F.col("content_event").isNotNull(), "content").when(leader == F.col("ordinal"), "new").when(F.col("model_leader").isNotNull(), "model").otherwise("title")
    decided = placed.select(F.col("ordinal").alias("content_first"), leader.alias("leader"), by.alias("by"))
    own = c.select(F.col("ordinal").alias("_lead"), "normalized_title").withColumn("new_event_id", F.sha2("normalized_title", 256)).drop("normalized_title")
    out = c.select("ordinal", "content_first").join(decided, "content_first")
    out = out.join(own, F.col("leader") == F.col("_lead"), "left").join(stored.select(F.col("event_no").alias("_no"), F.col("event_id").alias("old_event_id")), F.col("leader") == F.col("_no"), "left")
    return out.select(
        "ordinal",
        "leader",
        F.coalesce("old_event_id", "new_event_id").alias("event_id"),
        (F.col("leader") == F.col("ordinal")).alias("is_new_event"),
        F.when(F.col("ordinal") != F.col("content_first"), "content").otherwise(F.col("by")).alias("by"),
    )


def evidence_upgrades(evidence: DataFrame) -> DataFrame:
    """Why an article is better evidence than all before it for its event: upgrade_reason, null if it is not, and for an
    event's first article.

    evidence: article_id (order of arrival), event_id, source_is_primary, source_trust, event_status, event_discard_reason,
    event_confidence, event_primary_verified. The event's state is that at the start of the batch, except that
    primary sources of this batch verify it for the articles after them.
    """
    before = W.partitionBy("event_id").orderBy("article_id").rowsBetween(W.unboundedPreceding, -1)
    best = F.max(F.struct("source_is_primary", "source_trust")).over(before)
    verified = F.col("event_primary_verified") | F.coalesce(F.max("source_is_primary").over(before), F.lit(False))
    first = F.row_number().over(W.partitionBy("event_id").orderBy("article_id")) == 1
    e = evidence.withColumns({"_best": best, "_verified": verified, "_first": first})
    primary, trust = F.col("source_is_primary"), F.col("source_trust")
    reason = (
        F.when(F.col("_first"), None)
        .when(F.col("event_status") == "pending", "pending_event_new_evidence")
        .when((F.col("event_discard_reason") == "analysis_failed") & primary, "retry_failed_with_primary")
        .when(F.col("_best").isNull(), "first_material_evidence")
        .when(primary & ~F.col("_verified"), "primary_source_discovered")
        .when(trust >= F.col("_best.source_trust") + 10, "higher_trust_source")
        .when((F.col("event_confidence") < 0.6) & (primary | (trust > F.col("_best.source_trust"))), "low_confidence_better_evidence")
    )
    return e.withColumn("upgrade_reason", reason).drop("_best", "_verified", "_first")


def best_primary(articles: DataFrame) -> DataFrame:
    """event_id, primary_article_id and primary_source_url: the best primary article by source type and trust, the earliest
    among equals."""
    rank = F.struct(type_priority(F.col("source_type")).alias("p"), F.col("source_trust").alias("t"), (-F.col("article_id")).alias("o"))
    best = articles.where("source_is_primary").groupBy("event_id").agg(F.max_by(F.struct("article_id", "canonical_url"), rank).alias("b"))
    return best.select("event_id", F.col("b.article_id").alias("primary_article_id"), F.col("b.canonical_url").alias("primary_source_url"))


def decide(resolved: DataFrame, as_of: Column) -> DataFrame:
    """One decision per candidate, by the first rule that fits: too_old; seen before (pending re-analysis of a pending event, else
    already_seen); part of a known event (evidence re-analysis for better evidence, else duplicate); the prefilter's reason; else
    analyze.

    resolved: candidates with published_at, seen_article, event_status, is_new_event, upgrade_reason and reason.
    """
    decision = (
        F.when(outside_lookback(F.col("published_at"), as_of), "too_old")
        .when(F.col("seen_article").isNotNull(), F.when(F.col("event_status") == "pending", "pending_reanalysis").otherwise("already_seen"))
        .when(~F.coalesce("is_new_event", F.lit(True)), F.when(F.col("upgrade_reason").isNotNull(), "evidence_reanalysis").otherwise("duplicate"))
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .otherwise("analyze")
    )
    return resolved.withColumn("decision", decision)


def marked(decided: DataFrame) -> DataFrame:
    """decided candidates with what their decision or outcome marks: candidate_reason, article_reason and event_reason (why each is discarded;
    null: it is not), event_mark (the status that the event takes; null: it keeps its own) and analyses (1 or 0).

    decided: decision, is_new_event and outcome (analyzed, analysis_failed or high_hype of those that were analysed; null: not analysed).
    Candidates seen before and duplicates mark nothing. An old candidate marks its event only if it leads it; a failed
    analysis marks the candidate and the event, but not the article, which may be analysed again.
    """
    failed = F.when(F.col("outcome").isin("analysis_failed", "high_hype"), F.col("outcome"))
    reason = F.when(F.col("decision").isin(*UNMARKED), failed).otherwise(F.col("decision"))
    of_event = F.when((F.col("decision") != "too_old") | F.coalesce("is_new_event", F.lit(True)), reason)
    return decided.withColumns(
        {
            "candidate_reason": reason,
            "article_reason": F.when(reason != "analysis_failed", reason),
            "event_reason": of_event,
            "event_mark": F.when(of_event.isNotNull(), "discarded").when(F.col("outcome") == "analyzed", "analyzed"),
            "analyses": F.coalesce(F.col("outcome").isin("analyzed", "high_hype"), F.lit(False)).cast("int"),
        }
    )


def event_changes(marks: DataFrame) -> DataFrame:
    """What marked() candidates change of their events: event_id, status and discard_reason (by the last candidate that sets them, null if none
    does), analysis_count, and how many candidates and articles were discarded."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    return marks.groupBy("event_id").agg(
        last("event_mark").alias("status"),
        last("event_reason").alias("discard_reason"),
        F.sum("analyses").alias("analysis_count"),
        F.count("candidate_reason").alias("candidates_discarded"),
        F.count("article_reason").alias("articles_discarded"),
    )
