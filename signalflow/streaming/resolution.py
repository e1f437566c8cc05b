"""Resolution of candidates into events across micro-batches: each batch meets the stored events that it can match, not all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import MATCH_DAYS, MIN_CONTENT, already_seen, resolve_events
from ..operators.similarity import MIN_RATIO
from ..operators.snapshots import KeyedTable, keep_stored
from ..operators.tables import saved

#: Numbers of stored events lie so far below those of candidates: earlier ones first, all negative.
_STORED = -(1 << 62)


class EventIndex:
    """Stored articles by URL, contents by hash and events by number, each changed once by a batch.

    A batch reads the buckets of its URLs and content hashes, and of the events those that it finds by content and those first seen in the
    last MATCH_DAYS days, which are all that a title or a model can match. Events have a bucket for each stretch of days, so older days are
    not read. All three tables are read as they were before the batch, so a batch that runs again after a failure between them gives the
    same rows; it skips the tables that have it.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark = spark
        self.articles = KeyedTable(spark, folder + "/articles", "canonical_url string, article_id long, leader long", ["canonical_url"], buckets)
        self.contents = KeyedTable(spark, folder + "/contents", "content_hash string, leader long", ["content_hash"], buckets)
        self.events = KeyedTable(spark, folder + "/events", "day date, leader long, event_id string, title string, normalized_title string, first_seen_at timestamp", ["day", "leader"], buckets, bucket_by=["day"])
        # Where an event found by content is: its day.
        self.days = KeyedTable(spark, folder + "/days", "leader long, day date", ["leader"], buckets)

    def add(self, number: int, candidates: DataFrame, min_ratio: float = MIN_RATIO) -> None:
        """Resolve a batch of normalized candidates (ordinal: not negative and larger than in all earlier batches; discovered_at: not null).

        Events match by title and model if they were first seen in the MATCH_DAYS days before the batch's latest discovered_at. Input that is
        split in another way gives the same events as long as it spans no more days than these. Candidates without a URL are left out, further
        columns are not kept, an empty batch stores nothing, and a batch that all tables have is not resolved again."""
        if all(t.before(number + 1) == number for t in (self.articles, self.contents, self.events, self.days)):
            return
        columns = ["ordinal", "canonical_url", "content_hash", "normalized_title", "title", "summary", "exact_model_id", "discovered_at"]
        c = saved(candidates.where("canonical_url is not null").select(*columns), "batch-candidates")
        if c.isEmpty():
            return
        latest = F.lit(c.agg(F.max("discovered_at")).first()[0]).cast("timestamp")
        since = latest - F.expr(f"INTERVAL {MATCH_DAYS} DAYS")
        known = self.articles.matching(c, self.articles.before(number))
        new = saved(already_seen(c, known).where("seen_article is null").drop("seen_article"), "new-candidates")
        told = new.where(F.length("summary") >= MIN_CONTENT)
        contents = saved(self.contents.matching(told, self.contents.before(number)), "known-contents")
        by_content = self.days.matching(contents, self.days.before(number))
        version = self.events.before(number)
        live_days = self.spark.range(MATCH_DAYS + 1).select(F.date_sub(latest.cast("date"), F.col("id").cast("int")).alias("day"))
        keys = by_content.select("day", "leader")
        found = self.events.matching(keys, version).unionByName(self.events.of_buckets(live_days, version).where(F.col("first_seen_at").between(since, latest)))
        hashes = contents.groupBy("leader").agg(F.collect_set("content_hash").alias("content_hashes"))
        stored = found.distinct().join(hashes, "leader", "left").select(
            (F.col("leader") + _STORED).alias("event_no"), "event_id", "title", "normalized_title", F.lit(None).cast("string").alias("subject_name"), "first_seen_at",
            F.coalesce("content_hashes", F.array().cast("array<string>")).alias("content_hashes"),
        )
        led = resolve_events(new, saved(stored, "stored-events"), latest, min_ratio).select(
            "ordinal", "is_new_event", "event_id", F.when(F.col("leader") < 0, F.col("leader") - _STORED).otherwise(F.col("leader")).alias("leader")
        )
        placed = saved(new.join(led, "ordinal"), "placed-candidates")
        stay = {"leader": keep_stored, "article_id": keep_stored}
        lead = placed.where("is_new_event").select(F.to_date("discovered_at").alias("day"), "leader", "event_id", "title", "normalized_title", F.col("discovered_at").alias("first_seen_at"))
        self.events.apply(number, lead, [])
        self.days.apply(number, lead.select("leader", "day"), [])
        self.contents.apply(number, placed.where(F.length("summary") >= MIN_CONTENT).select("content_hash", "leader", (-F.col("leader")).alias("_o")), ["_o"], stay)
        self.articles.apply(number, placed.select("canonical_url", F.col("ordinal").alias("article_id"), "leader"), [], stay)


def resolved(stream: DataFrame, index: EventIndex, checkpoint: str, min_ratio: float = MIN_RATIO) -> StreamingQuery:
    """Resolve a stream of normalized candidates, micro-batch by micro-batch, until the input is used up."""
    return stream.writeStream.foreachBatch(lambda batch, number: index.add(number, batch, min_ratio)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
