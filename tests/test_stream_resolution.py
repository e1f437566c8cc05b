import pytest
from pyspark.sql import functions as F

from signalflow.operators import evidence
from signalflow.sources import adapters as A
from signalflow.streaming import resolution, streams

NONE = "event_no long, event_id string, title string, normalized_title string, subject_name string, first_seen_at timestamp, content_hashes array<string>"


@pytest.fixture(scope="module")
def candidates(spark, sf_dir, tmp_path_factory):
    """Documents with copies of contents, URLs and titles far apart, in the order of arrival."""
    path = f"file://{tmp_path_factory.mktemp('c')}/c"
    c = A.normalized(A.candidates(spark, sf_dir)).where("ordinal < 60")
    seen = F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(hours=F.col("ordinal").cast("int"))
    c = c.withColumn("discovered_at", seen)
    again = c.where("ordinal % 5 = 1").withColumns({"ordinal": F.col("ordinal") + 40, "canonical_url": F.concat("canonical_url", F.when(F.col("ordinal") % 2 == 0, "/x").otherwise(""))})
    similar = c.where("ordinal % 7 = 2").withColumns({"ordinal": F.col("ordinal") + 100, "canonical_url": F.concat("canonical_url", F.lit("/y")), "normalized_title": F.concat("normalized_title", F.lit("s")), "content_hash": F.concat(F.lit("other"), "content_hash")})
    c.where("ordinal < 40").unionByName(again).unionByName(similar).drop("discard_reason").withColumn("leader", F.lit("clash")).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(index):
    return {r.canonical_url: (r.article_id, r.leader) for r in index.articles.rows().collect()}, {r.leader: r.event_id for r in index.events.rows().collect()}


def test_split_and_replayed_batches_give_the_events_of_one(spark, candidates, tmp_path):
    new = evidence.already_seen(candidates, spark.createDataFrame([], "article_id long, canonical_url string")).where("seen_article is null").drop("seen_article", "leader")
    whole = evidence.resolve_events(new, spark.createDataFrame([], NONE), F.lit("2024-01-30").cast("timestamp"))
    led = {r.ordinal: (r.leader, r.event_id) for r in whole.collect()}
    want = {r.canonical_url: (r.ordinal, led[r.ordinal][0]) for r in new.collect()}
    events = {leader: event for leader, event in led.values()}
    assert len(events) < len(want) < candidates.count()
    index = resolution.EventIndex(spark, f"file://{tmp_path}/i", buckets=4)
    parts = [candidates.where("ordinal < 30"), candidates.where("ordinal >= 30")]
    index.add(0, parts[0])
    # The second batch fails between its tables, and runs again.
    apply, index.contents.apply = index.contents.apply, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        index.add(1, parts[1])
    index.contents.apply = apply
    index.add(1, parts[1])
    index.add(1, parts[1])
    index.add(2, parts[1].where("false"))
    index.add(0, parts[1])
    assert rows_of(index) == (want, events)


def test_old_events_match_by_content_only(spark, candidates, tmp_path):
    c = candidates.where("ordinal < 8 and length(summary) >= 40")
    later = c.withColumns({"ordinal": F.col("ordinal") + 500, "discovered_at": F.col("discovered_at") + F.expr("INTERVAL 40 DAYS"), "canonical_url": F.concat("canonical_url", F.lit("/later"))})
    other = later.withColumns({"ordinal": F.col("ordinal") + 500, "canonical_url": F.concat("canonical_url", F.lit("/other")), "content_hash": F.concat(F.lit("-"), "content_hash")})
    for land, rows in enumerate((c, later.unionByName(other))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{land}")
    index = resolution.EventIndex(spark, f"file://{tmp_path}/i", buckets=4)
    stream = streams.landed(spark, f"file://{tmp_path}/in/*", candidates.schema, files_per_trigger=1)
    for _ in range(2):
        resolution.resolved(stream, index, f"{tmp_path}/check").awaitTermination(200)
    leaders = {r.article_id: r.leader for r in index.articles.rows().collect()}
    first = {n for n in leaders if n < 500}
    assert all(leaders[n + 500] == leaders[n] for n in first) and all(leaders[n + 1000] >= 1000 for n in first) and len(leaders) == 3 * len(first)
