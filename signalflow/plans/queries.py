"""The registered queries: each applies functions of the library to the given tables, as the adapters read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import analysis, evidence, intervals, prefilter, similarity, terms
from ..operators.snapshots import KeyedTable, keep_stored
from ..operators.tables import new_folder, saved
from ..sources import adapters as A
from ..sources import config as C
from ..sources import pages as P
from . import alerts, digest, health, reports, runs

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _registry[f.__name__] = f
    return f


def epoch(name: str):
    return F.unix_timestamp(name).alias(name)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normalized(A.candidates(spark, sf_dir))


@_query
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical_url"))


@_query
def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.candidates(spark, sf_dir)
    return c.select("ordinal", T.normalized_title(T.clean_title(F.col("title"))).alias("normalized_title"))


@_query
def first_sentence_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidates(spark, sf_dir).select("ordinal", "title")


@_query
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evidence.content_groups(_candidates(spark, sf_dir))
    return c.select("ordinal", "content_hash", "content_first", (F.col("ordinal") != F.col("content_first")).alias("is_copy"))


@_query
def model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of names that are made of each document's number, in the spellings of known families."""
    d = A.table(spark, sf_dir, "documents")
    n, size = (F.col("doc_id") % 5).cast("string"), (F.col("doc_id") % 70 + 1).cast("string")
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("New model repository: Qwen/Qwen"), n, F.lit("-"), size, F.lit("B-Instruct")))
        .when(kind == 1, F.concat(F.lit("GLM "), n, F.lit(".5 "), size, F.lit("b FP8")))
        .when(kind == 2, F.concat(F.lit("deepseek_"), n))
        .when(kind == 3, F.concat(F.lit("Command R+ "), size, F.lit("B chat")))
        .when(kind == 4, F.lit("Commander R"))
        .otherwise(F.concat(F.lit("about llama "), n))
    )
    return d.select("doc_id", T.model_identity(name).alias("identity"))


@_query
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.with_keyword_score(_candidates(spark, sf_dir), C.active_terms()).select("ordinal", "keyword_score")


@_query
def many_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of five letters or more of all titles as terms, looked for as parts of all candidates' texts."""
    c = _candidates(spark, sf_dir).select(F.col("ordinal").alias("id"), "normalized_title", T.candidate_text(F.col("normalized_title"), F.col("summary")).alias("text"))
    words = c.select(F.explode(F.split("normalized_title", " ")).alias("term")).where(F.length("term") >= 5).distinct()
    weighed = words.withColumn("weight", ((F.length("term") % 5 + 1) / 1000).cast("decimal(10,4)"))
    return terms.term_scores(c.select("id", "text"), weighed).select(F.col("id").alias("ordinal"), "n_terms", "keyword_score")


@_query
def errors_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the errors that its user had in the 14 days before: how many, the first and the last."""
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    met = intervals.with_recent(bought, errors, ["user_id"], "ts", "error_ts", evidence.MATCH_DAYS).groupBy("event_id")
    found = met.agg(F.count("*").alias("n_errors"), F.min_by("error_id", F.struct("error_ts", "error_id")).alias("first_error"), F.max_by("error_id", F.struct("error_ts", "error_id")).alias("last_error"))
    return bought.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first_error", "last_error")


@_query
def prefilter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prefilter.prefiltered(_candidates(spark, sf_dir), C.active_terms(), A.as_of(), hours=720, min_score=20)
    return c.select("ordinal", "reason", "primary_bypass")


@_query
def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety signals of documents whose titles are completed by fixed phrases, by their number."""
    c = _candidates(spark, sf_dir)
    title = F.concat("title", F.when(F.col("ordinal") % 3 == 0, " calls for a moratorium").otherwise(""), F.when(F.col("ordinal") % 4 == 0, " says Yoshua_Bengio").otherwise(""))
    return c.select("ordinal", prefilter.safety_signal(title, F.col("summary")).alias("is_safety"))


@_query
def already_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against articles stored before: every eighth of them."""
    c = _candidates(spark, sf_dir)
    stored = c.where("ordinal % 8 = 0").select((-F.col("ordinal") - 1).alias("article_id"), "canonical_url")
    return evidence.already_seen(c, stored).select("ordinal", "canonical_url", "seen_article")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(F.col("ordinal").alias("id"), F.col("normalized_title").alias("title"))


@_query
def similar_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles that are similar, by their first candidates."""
    first = _titles(spark, sf_dir).groupBy("title").agg(F.min("id").alias("id"))
    return similarity.similar_titles(first)


@_query
def event_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all new URLs, against every tenth title as an event stored before."""
    # Texts are worked out once; of summaries it only counts whether they are long enough to tell.
    c = _candidates(spark, sf_dir).withColumn("summary", F.substring("summary", 1, evidence.MIN_CONTENT))
    c = saved(c.select("ordinal", "canonical_url", "content_hash", "normalized_title", "title", "summary", "exact_model_id"), "event-candidates")
    new = evidence.already_seen(c, c.limit(0).select(F.col("ordinal").alias("article_id"), "canonical_url")).where("seen_article is null")
    old = c.where("ordinal % 10 = 0").groupBy("normalized_title").agg(F.min("ordinal").alias("n"), F.min_by("title", "ordinal").alias("title"), F.collect_set("content_hash").alias("content_hashes"))
    stored = old.select(
        (-F.col("n") - 1).alias("event_no"), F.sha2("normalized_title", 256).alias("event_id"), "title", "normalized_title", F.lit("").alias("subject_name"),
        (A.as_of() - F.make_dt_interval(F.lit(0), (F.col("n") * 7 % 600).cast("int"))).alias("first_seen_at"), "content_hashes",
    )
    return evidence.resolve_events(new, stored, A.as_of())


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.articles(spark, sf_dir)
    e = A.events(spark, sf_dir).select("event_id", F.col("status").alias("event_status"), "event_discard_reason", F.col("confidence").alias("event_confidence"), F.lit(False).alias("event_primary_verified"))
    return a.join(e, "event_id")


@_query
def best_primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.best_primary(A.articles(spark, sf_dir))


@_query
def evidence_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_upgrades(_evidence(spark, sf_dir)).select("article_id", "event_id", "upgrade_reason")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all candidates, with events by exact title."""
    c = prefilter.prefiltered(_candidates(spark, sf_dir), C.active_terms(), A.as_of(), hours=720, min_score=20)
    c = evidence.already_seen(c, c.where("ordinal < 0").select(F.col("ordinal").alias("article_id"), "canonical_url"))
    up = evidence.evidence_upgrades(_evidence(spark, sf_dir)).select(F.col("article_id").alias("ordinal"), "event_id", "event_status", "upgrade_reason")
    k = A.events(spark, sf_dir).select("event_id", "k")
    j = c.join(up, "ordinal").join(k, "event_id").withColumn("is_new_event", F.col("ordinal") == F.col("k"))
    return evidence.decide(j, A.as_of() - F.expr("INTERVAL 672 HOURS")).withColumn("run_no", (F.col("ordinal") % 360).cast("int"))


@_query
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("ordinal", "event_id", "decision")


@_query
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of events after a run: what decisions and analyses of all candidates mark goes over what was stored. Outcomes of
    analyses follow from the candidates' numbers."""
    schema = "event_id string, status string, discard_reason string, analysis_count long, candidates_discarded long, articles_discarded long"
    none = F.lit(0).cast("long")
    table = KeyedTable(spark, new_folder(spark, "events"), schema, ["event_id"], buckets=16)
    before = A.events(spark, sf_dir).select("event_id", "status", F.col("event_discard_reason").alias("discard_reason"), none.alias("analysis_count"), none.alias("candidates_discarded"), none.alias("articles_discarded"))
    table.apply(0, before, [])
    outcome = F.when(F.col("decision").isin(*runs.KEPT), F.when(F.col("ordinal") % 13 == 5, "analysis_failed").when(F.col("ordinal") % 17 == 3, "high_hype").otherwise("analyzed"))
    changes = evidence.event_changes(evidence.marked(_decisions(spark, sf_dir).withColumn("outcome", outcome)))
    keep, add = lambda old, new: F.coalesce(new, old), lambda old, new: old + new
    table.apply(1, changes, [], {"status": keep, "discard_reason": keep, "analysis_count": add, "candidates_discarded": add, "articles_discarded": add})
    return table.rows()


@_query
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of scores after three runs, each of which scores some events and profiles anew: one row for each event and profile."""
    table = KeyedTable(spark, new_folder(spark, "scores"), "event_id string, profile_id int, alert_score int, suggested_action string, first_run int, last_run int, runs int", ["event_id", "profile_id"], buckets=16)
    s = A.event_scores(spark, sf_dir)
    m = F.pmod(F.col("k") + F.col("profile_id"), F.lit(4))
    for run, some in ((1, (0, 1, 2)), (2, (1, 3)), (3, (2, 3))):
        score = ((F.col("alert_score") + 7 * run) % 101).cast("int")
        rows = s.where(m.isin(*some)).select("event_id", "profile_id", score.alias("alert_score"), "suggested_action", F.lit(run).alias("first_run"), F.lit(run).alias("last_run"), F.lit(1).alias("runs"))
        table.apply(run, rows, ["last_run"], {"first_run": keep_stored, "runs": lambda old, new: old + new})
    return table.rows()


@_query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.run_summary(_decisions(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("discards")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.withColumn("discards", text)


@_query
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all runs, counted from the log that they wrote: first with half of the rows each, as if they had failed, then again whole.
    Calls and their usage follow from the candidates' numbers and the lengths of their texts."""
    d, n = _decisions(spark, sf_dir), F.col("ordinal")
    called = F.col("decision").isin(*runs.KEPT)
    usage = d.select(
        "run_no", "ordinal", "decision", "seen_article", "primary_bypass", called.alias("called"), (called & (n % 11 == 0)).alias("retried"), F.when(called & (n % 13 == 5), "invalid_response").alias("error"),
        F.when(called, F.length("summary").cast("long")).alias("input_tokens"), F.when(called, n * 7 % 200).alias("output_tokens"), F.when(called, F.length("summary") * 3 + n * 7 % 200 * 15).alias("cost_micros"),
        (called & (n % 13 != 5) & (n % 10 == 1)).alias("alerted"),
    )
    folder = new_folder(spark, "run-log")
    runs.write_log(usage.where("ordinal % 2 = 0"), folder)
    runs.write_log(usage, folder)
    found = runs.records(spark.read.parquet(folder + "/decisions"), call_limit=2)
    return found.withColumn("discards", F.array_join(F.transform(F.array_sort(F.map_entries("discards")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@_query
def alert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir).select("event_id", "confidence", "hype")
    first = A.articles(spark, sf_dir).groupBy("event_id").agg(F.min_by(F.struct("source_trust", "source_is_primary"), "article_id").alias("s"))
    s = A.event_scores(spark, sf_dir).join(e, "event_id").join(first.select("event_id", "s.source_trust", "s.source_is_primary"), "event_id")
    return analysis.scored(s).select("event_id", "slug", "final_alert", "category")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.event_maxima(A.event_scores(spark, sf_dir).where("enabled")).select("event_id", "max_alert")
    e = A.events(spark, sf_dir).join(m, "event_id").withColumn("is_safety", F.col("k") % 5 == 0)
    return analysis.outcome(e)


@_query
def high_hype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("event_id", "threshold", "high_hype", "alerts")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts sent before: those of every third event."""
    e = A.events(spark, sf_dir).where("k % 3 = 0")
    return e.select(F.concat(F.lit("old-"), F.col("k").cast("string")).alias("alert_id"), "event_id", F.lit("immediate").alias("alert_type"), F.lit("telegram").alias("channel"), F.when(F.col("k") % 2 == 0, "sent").otherwise("failed").alias("delivery_status"))


@_query
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = _outcomes(spark, sf_dir).where("alerts").select("event_id", F.concat(F.lit("<b>"), T.html_escape(F.col("title")), F.lit("</b>")).alias("text"))
    return analysis.reserve_alerts(due, _alerts(spark, sf_dir))


@_query
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all events whose alerts are due, with fixed sentences in place of generated ones."""
    due = _outcomes(spark, sf_dir).where("alerts")
    first = A.articles(spark, sf_dir).groupBy("event_id").agg(F.min_by(F.struct("source_trust", "source_is_primary", "canonical_url"), "article_id").alias("a"))
    e = due.join(first, "event_id").select(
        "event_id", "title", "confidence", "hype", "a.source_is_primary", (F.col("a.source_trust") < 60).alias("source_requires_primary"), "a.canonical_url",
        F.concat(F.lit("<"), F.col("title"), F.lit(">")).alias("what_happened"), F.lit("It's new & matters").alias("why_it_matters"),
    )
    icons = spark.createDataFrame([(p[0], p[3]) for p in C.SAMPLE_PROFILES], "profile_id int, icon string")
    s = A.event_scores(spark, sf_dir).where("enabled").join(F.broadcast(icons), "profile_id").withColumn("reason", F.concat(F.lit("fits "), F.col("slug")))
    return alerts.alert_messages(e, s)


@_query
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_detail(A.events(spark, sf_dir), 50).select("event_id", "status", epoch("last_seen_at"))


@_query
def high_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.high_signal(A.events(spark, sf_dir), A.event_scores(spark, sf_dir), A.articles(spark, sf_dir), A.as_of()).select("event_id", "max_alert", "top_profile", epoch("recency_at"))


@_query
def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, s = A.events(spark, sf_dir), A.articles(spark, sf_dir), A.event_scores(spark, sf_dir)
    found = reports.filtered_events(e, a, s, A.as_of(), search="th", days=30, min_relevance=50, min_alert=40)
    rows = reports.event_list(found, s, a, A.as_of(), page=2)
    return rows.select("event_id", epoch("last_seen_at"), "source_id", "max_alert", "max_relevance", epoch("recency_at"), "historical", "ago")


@_query
def filtered_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.filtered_events(A.events(spark, sf_dir), A.articles(spark, sf_dir), A.event_scores(spark, sf_dir), A.as_of(), primary=True, source_id="src3", profile="teaching")
    return found.agg(F.count("*").alias("events"), F.ceil(F.count("*") / reports.PAGE_ROWS).alias("pages"))


@_query
def event_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.badges(A.event_scores(spark, sf_dir))


@_query
def latest_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_articles(A.articles(spark, sf_dir)).select("event_id", "article_id", epoch("published_at"))


@_query
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.event_detail(A.events(spark, sf_dir), A.event_scores(spark, sf_dir), A.articles(spark, sf_dir))


@_query
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_stats(A.articles(spark, sf_dir)).select("source_id", "items", epoch("last_discovered"), epoch("last_published"))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health.with_status(A.source_health(spark, sf_dir), A.as_of())
    return h.withColumn("source_id", F.concat(F.lit("src"), F.col("source_no").cast("string")))


@_query
def sources_with_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sources(spark, sf_dir).where("source_id <> 'src4'").unionByName(A.sources(spark, sf_dir).where("source_id = 'src4'").withColumn("source_id", F.lit("none")))
    r = reports.sources_report(s, _health(spark, sf_dir), reports.source_stats(A.articles(spark, sf_dir)))
    return r.select("source_id", "source_type", "name", "enabled", "health", epoch("last_published"))


@_query
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("source_id", "items_found", epoch("latest_item_at"), "status")


@_query
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_summary(A.sources(spark, sf_dir), _health(spark, sf_dir))


@_query
def system_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.system_state(reports.health_summary(A.sources(spark, sf_dir), _health(spark, sf_dir)), A.runs(spark, sf_dir), A.as_of())


@_query
def runs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.run_list(A.runs(spark, sf_dir))
    return r.select("run_no", "status", "collected", "analyzed", epoch("started_at"), "seconds")


@_query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs(spark, sf_dir).withColumn("run_no", (F.col("run_no") % 360).cast("int"))
    return reports.run_events(r, A.events(spark, sf_dir), A.event_scores(spark, sf_dir), 50, limit=40).select("event_id", "status", "max_alert", "max_relevance")


@_query
def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.runs(spark, sf_dir).select("run_no", S.llm_cost(F.col("input_tokens"), F.col("output_tokens"), 0.5, 2.0).alias("cost_usd"))


@_query
def candidate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).select("ordinal", F.when(F.col("ordinal") % 11 != 0, F.col("ordinal")).alias("article_id"), "source_name", "decision")
    return reports.lineage(d, A.articles(spark, sf_dir), A.events(spark, sf_dir), A.sources(spark, sf_dir))


def _digest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = A.event_scores(spark, sf_dir)
    period = digest.period_events(A.events(spark, sf_dir), s, A.articles(spark, sf_dir), _alerts(spark, sf_dir), A.as_of(), hours=240)
    return digest.ranked(period), s


@_query
def digest_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, _ = _digest(spark, sf_dir)
    return top.select("event_id", "max_alert", "max_relevance", "max_actionability", "category", "alerted_before", epoch("recency_at"))


@_query
def digest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.category_counts(_digest(spark, sf_dir)[0])


@_query
def digest_profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.profile_counts(*_digest(spark, sf_dir))


@_query
def digest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.top_actions(*_digest(spark, sf_dir))


@_query
def event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.best_action(A.event_scores(spark, sf_dir))


@_query
def digest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, s = _digest(spark, sf_dir)
    return digest.messages(digest.blocks(top, s).withColumn("digest_id", F.lit("now")))


@_query
def anchor_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of texts that are completed by product names, by the document's number."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    k, v = F.col("doc_id"), (F.col("doc_id") % 4).cast("string")
    title = F.concat(F.lit("GPT-"), v, F.lit(" and deepseek-v"), (k % 3).cast("string"), F.lit(" released"))
    text = F.concat(F.lit("It is about gpt-"), (k % 5).cast("string"), F.lit(" only"))
    model = F.when(k % 2 == 0, F.concat(F.lit("lab/Model_"), v))
    subject = F.when(k % 8 == 0, F.lit("another")).otherwise(F.concat(F.lit("Model "), v))
    found = analysis.anchor_contradictions(title, F.col("text"), model, subject, text)
    return d.select("doc_id", F.array_join(found, ",").alias("contradictions"))


@_query
def class_closed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.event_scores(spark, sf_dir).select("event_id", "slug", F.array(F.col("relevance_score") % 8, F.col("alert_score") % 8, F.lit(1)).alias("related_classes"))
    c = analysis.closed_classes(s, C.profiles_table(spark))
    text = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",")
    return c.select("event_id", "slug", text("valid_classes").alias("valid_classes"), text("invalid_classes").alias("invalid_classes"))


@_query
def analysis_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made of events and scores as JSON, some broken, parsed and validated."""
    s = A.event_scores(spark, sf_dir).where("enabled").select("event_id", F.struct(F.col("slug").alias("profile"), "relevance_score", F.lit(50).alias("novelty_score"), "actionability_score", F.lit(50).alias("strategic_impact_score"), "alert_score", F.lit("fits").alias("reason"), "suggested_action", F.array(F.lit("x")).alias("related_topics"), F.array(F.lit(1)).alias("related_classes")).alias("p"), "profile_id", F.col("profile_id").alias("n"))
    e = A.events(spark, sf_dir).select("event_id", "k", "confidence", "hype")
    g = s.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("ps")).join(e, "event_id")
    body = F.struct(
        F.lit("subject").alias("subject_name"), F.lit("model").alias("subject_type"), F.when(F.col("k") % 13 == 0, "a %C3%A9 b").otherwise("summary").alias("summary"), F.lit("x").alias("what_happened"), F.lit("y").alias("why_it_matters"),
        F.when(F.col("k") % 17 == 0, 101).otherwise(60).alias("novelty_score"), F.lit(70).alias("credibility_score"), "confidence", F.col("hype").alias("hype_probability"),
        F.when(F.col("k") % 19 == 0, F.transform(F.slice("ps", 1, 2), lambda x: x["p"])).otherwise(F.transform("ps", lambda x: x["p"])).alias("profiles"),
    )
    content = F.when(F.col("k") % 7 == 0, "{broken").otherwise(F.to_json(body))
    usage = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"prompt_tokens":'), F.col("k").cast("string"), F.lit(',"completion_tokens":5}'))).otherwise(F.concat(F.lit('{"input_tokens":'), F.col("k").cast("string"), F.lit(',"output_tokens":6}')))
    parsed = analysis.parsed(g.select("event_id", usage.alias("usage"), content.alias("content")))
    slugs = [p[1] for p in C.SAMPLE_PROFILES if p[4]]
    return parsed.select("event_id", "input_tokens", "output_tokens", F.size("analysis.profiles").alias("n_profiles"), analysis.invalid_reason(F.col("analysis"), slugs).alias("problem"))


@_query
def profiles_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles stored per source of the documents, synced with a config that lacks each third and adds one for each language."""
    d = A.table(spark, sf_dir, "documents")
    stored = d.select(F.col("source").alias("slug")).distinct().select("slug", F.upper("slug").alias("name"), F.lit("*").alias("icon"), F.lit(True).alias("enabled"))
    number = F.regexp_extract("slug", r"(\d+)", 1).try_cast("int")
    config = stored.where(number % 3 != 0).withColumn("name", F.concat("name", F.lit("!"))).unionByName(
        d.select(F.col("lang").alias("slug")).distinct().select("slug", "slug", F.lit("+"), F.lit(True)).toDF("slug", "name", "icon", "enabled")
    )
    return health.synced_profiles(stored, config)


@_query
def source_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each source's candidates wins, new ones over stored ones."""
    c = A.candidates(spark, sf_dir).select("source_type", "source_url", "title", "ordinal")
    out = health.upserted(c.where("ordinal % 2 = 0"), c.where("ordinal % 2 = 1"), ["source_type", "source_url"], "ordinal")
    return out.select("source_type", "source_url", "ordinal")


@_query
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all pages, read as whole pages."""
    p = A.table(spark, sf_dir, "pages")
    raw = p.select(F.col("page_id").cast("string").alias("source_id"), "url", F.col("html").alias("body"), F.when(F.col("page_id") % 41 == 0, 503).otherwise(200).alias("http_status"))
    return P.extract(raw, "page").select("source_id", "position", "title", "error")


@_query
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.articles(spark, sf_dir)
    return a.select("article_id", S.relative_time(F.col("published_at"), A.as_of()).alias("ago"), S.is_historical(F.col("published_at"), A.as_of()).alias("historical"), S.local_time(F.col("published_at")).alias("local"))


def queries() -> dict[str, Query]:
    return dict(_registry)
