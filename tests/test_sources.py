from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalflow.operators import analysis
from signalflow.plans import digest, health, reports
from signalflow.sources import adapters as A
from signalflow.sources import config as C
from signalflow.sources import feeds, pages
from signalflow.streaming import streams

SOURCE = ("feed", "http://f", 90, True, "rss")


def bodies(spark, *texts, schema=""):
    return spark.createDataFrame([(*SOURCE, t) for t in texts], "source_name string, source_url string, source_trust int, source_is_primary boolean, source_type string, body string")


def test_rss_and_atom(spark):
    rss = """<rss><channel><title>t</title>
      <item><title>First</title><link>http://a/1</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><guid>g1</guid><source>Acme</source></item>
      <item><title> - </title><link>http://a/2</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate><source>ACME</source></item>
      <item><title>Other</title><link>http://a/3</link><source>Else</source></item></channel></rss>"""
    rows = feeds.rss(bodies(spark, rss, "not xml"), publishers=["acme"]).orderBy("position").collect()
    assert [(r.title, r.url, r.summary) for r in rows] == [("First", "http://a/1", "d"), ("New post from feed", "http://a/2", "")]
    assert [str(r.published_at) for r in rows] == ["2024-01-01 10:00:00", "2024-01-02 08:00:00"]
    assert feeds.rss(bodies(spark, rss), limit=1).count() == 1
    atom = '<feed><entry><title>A</title><link href="http://b/1"/><updated>2024-01-03T00:00:00Z</updated><id>x</id></entry></feed>'
    (row,) = feeds.rss(bodies(spark, atom)).collect()
    assert (row.title, row.url, str(row.published_at)) == ("A", "http://b/1", "2024-01-03 00:00:00")


def test_releases_and_models(spark):
    body = '[{"id":1,"name":"","tag_name":"v1","html_url":"http://r/1","published_at":"2024-01-01T00:00:00Z","body":"b","draft":false,"prerelease":true},{"id":2,"name":"n","tag_name":"v2","html_url":"u","body":"x","draft":true}]'
    (r,) = feeds.releases(bodies(spark, body)).collect()
    assert (r.title, r.summary, r.external_id) == ("v1", "Pre-release. b", "1")
    hub = '[{"id":"org/m","createdAt":"2024-01-01T00:00:00.000Z","lastModified":"x","tags":["a","b"]},{"id":"org/n"}]'
    (m,) = feeds.models(bodies(spark, hub, "oops"), "https://hub.example").collect()
    assert (m.title, m.url, m.summary, m.exact_model_id) == ("New model repository: org/m", "https://hub.example/org/m", "Tags: a, b", "org/m")


def test_sitemap_scripts_and_cards(spark):
    xml = "<urlset><url><loc>http://s/essays/why-ai-matters/</loc><lastmod>2024-01-05</lastmod></url><url><loc>http://s/about</loc></url></urlset>"
    (e,) = feeds.sitemap(bodies(spark, xml), "/essays/").collect()
    assert (e.title, str(e.published_at)) == ("Why AI Matters", "2024-01-05 00:00:00")
    page = '<script>{"title":"A","slug":"a"},{"title":"B","slug":"b"}</script>'
    got = feeds.script_entries(bodies(spark, page), {"title": '"title":"([^"]*)"', "slug": '"slug":"([^"]*)"'}).orderBy("position").collect()
    assert [(r.title, r.slug) for r in got] == [("A", "a"), ("B", "b")]
    cards = spark.createDataFrame([("f", "u", 0, "old"), ("f", "v", 1, "x"), ("f", "u", 2, "new")], "source_name string, url string, position int, title string")
    assert sorted((r.url, r.position, r.title) for r in feeds.last_cards(cards).collect()) == [("u", 0, "new"), ("v", 1, "x")]


def test_page_layouts(spark):
    html = '<html><body><article><h2>One &amp; two</h2><p>sum</p><a href="/p/1">x</a><time datetime="2024-01-01">y</time></article><article><p>no title</p></article><div class="post-item big"><h3><a href="q">Three</a></h3></div></body></html>'
    assert pages.page_items(html, "http://h/b/", pages.LAYOUTS["cards"]) == [{"item_url": "http://h/p/1", "title": "One & two", "summary": "sum", "published_at": "2024-01-01"}]
    assert pages.page_items(html, "http://h/b/", pages.LAYOUTS["post-items"]) == [{"item_url": "http://h/b/q", "title": "Three", "summary": "", "published_at": None}]
    rows = [("a", "http://h/", html, 200, "cards"), ("b", "http://h/", html, 503, "cards"), ("c", "http://h/", None, 200, "cards"), ("d", "http://h/", html, 200, "none"), ("e", "http://h/", "<article><h2>cut", 200, "cards")]
    got = pages.extract(spark.createDataFrame(rows, "source_id string, url string, body string, http_status int, layout string")).collect()
    assert sorted((r.source_id, r.title, r.error) for r in got) == [("a", "One & two", None), ("b", None, "HTTP_ERROR"), ("c", None, "EMPTY"), ("d", None, "PARSE_ERROR"), ("e", "cut", None)]


def test_titles_cut_within_an_entity_keep_its_letters():
    """As in the SQL of the query page_items: entities of whole pages end with a semicolon."""
    title = lambda t: pages.page_items(f"<html><head><title>{t}</title></head><body>x</body></html>", "http://h/", pages.LAYOUTS["page"])[0]["title"]
    for text, want in [("A &amp; b&amp", "A & b&amp"), ("a&quot", "a&quot"), ("a&am", "a&am"), ("&ampfoo; &#39 &#39; &#x27; &eacute;", "&ampfoo; &#39 ' ' é"), ("&amp;amp; &", "&amp; &"), ("&amp;lt", "&lt")]:
        assert title(text) == want
    assert pages.page_items("<article><h2>a &copy b</h2></article>", "http://h/", pages.LAYOUTS["cards"])[0]["title"] == "a © b"


def test_pages_of_dated_headings(spark):
    lists = '<h2>no id</h2><ul><li>skipped</li></ul><h2 id="may">May 2, 2024</h2><p>intro</p><ul><li><strong>Fast</strong> mode <ul><li>inner</li></ul> is <a href="/x">here</a></li><li>Second one. More.</li></ul><h2 id="b">2024-04-01</h2><li>cut'
    assert pages.page_items(lists, "http://h/log", pages.SECTIONS["dated-lists"]) == [
        {"item_url": "http://h/x", "title": "Fast", "summary": "Fast mode inner is here", "published_at": "May 2, 2024"},
        {"item_url": "http://h/log#may-2", "title": "", "summary": "Second one. More.", "published_at": "May 2, 2024"},
        {"item_url": "http://h/log#b-1", "title": "", "summary": "cut", "published_at": "2024-04-01"},
    ]
    heads = '<h3 id="early">no date yet</h3><h2 id="date-2024-03-01">Version</h2><h3 id="v2">V 2 &amp; on</h3><p>first</p><script>no</script><p>next</p><hr><p>after</p><h3>none</h3><p>x</p><h3 id="v1">V 1</h3><h2>end</h2><p>y</p>'
    assert pages.page_items(heads, "http://h/log", pages.SECTIONS["dated-headings"]) == [
        {"item_url": "http://h/log#v2", "title": "V 2 & on", "summary": "first next", "published_at": "2024-03-01"},
        {"item_url": "http://h/log#v1", "title": "V 1", "summary": "", "published_at": "2024-03-01"},
    ]
    rows = [("a", "http://h/log", lists, 200, "dated-lists"), ("b", "http://h/log", "<h2>x</h2>", 200, "dated-headings")]
    got = pages.extract(spark.createDataFrame(rows, "source_id string, url string, body string, http_status int, layout string")).collect()
    assert sorted((r.source_id, r.position, r.title, r.error) for r in got if r.position != 2) == [("a", 0, "Fast", None), ("a", 1, "Second one.", None), ("b", None, None, "EMPTY")]


def test_anchor_contradictions(spark):
    cases = [
        ("GPT-4 is out", "", None, "x", "about gpt-4", []), ("GPT-4 is out", "", None, "x", "about gpt-5 and gpt-4", ["gpt-5"]), ("nothing named", "", None, "x", "about gpt-5", []),
        ("t", "", "lab/Qwen3", "qwen3", "gpt-5", ["gpt-5"]), ("t", "", "lab/Qwen3", "llama", "", ["subject:llama"]),
    ]
    f = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, title string, summary string, model string, subject string, text string")
    got = f.select("i", analysis.anchor_contradictions(*[F.col(c) for c in ("title", "summary", "model", "subject", "text")]).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c[5] for c in cases]


def test_alerts_are_reserved_once(spark):
    due = spark.createDataFrame([("e1", "t"), ("e2", "u"), ("e2", "u")], "event_id string, text string")
    old = spark.createDataFrame([("a", "e1", "immediate", "telegram", "sent")], "alert_id string, event_id string, alert_type string, channel string, delivery_status string")
    new = analysis.reserve_alerts(due, old)
    assert [r.event_id for r in new.collect()] == ["e2"]
    assert analysis.reserve_alerts(due, old.unionByName(new.select(old.columns))).count() == 0
    done = analysis.delivered(new, new.select("alert_id", F.lit(False).alias("sent"))).collect()
    assert [r.delivery_status for r in done] == ["failed"]
    payload = analysis.requests(spark.createDataFrame([("e", "t", "s", "n")], "event_id string, title string, summary string, source_name string").withColumn("published_at", A.as_of()), C.SAMPLE_PROFILES).first().payload
    assert '"slug":"finance"' in payload and "archive" not in payload


def test_messages(spark):
    packed = digest.pack_blocks(["a" * 30, "b" * 30, "line one\n" + "w " * 60 + "\nlast"], 150)
    assert all(len(m) <= 150 + 30 for m in packed) and packed[0].startswith("<b>DIGEST (1/")
    assert "a" * 30 + digest.SEPARATOR + "b" * 30 in packed[0]
    with pytest.raises(ValueError):
        digest.pack_blocks(["x" * 200], 100)
    rows = digest.messages(spark.createDataFrame([("d", 2, "two"), ("d", 1, "one")], "digest_id string, place int, text string"))
    assert rows.first().text == "<b>DIGEST</b>\n\none" + digest.SEPARATOR + "two"
    none = spark.createDataFrame([], "status string, idempotency_key string")
    row = digest.reserved(rows, none, A.as_of())
    assert row.count() == 1 and digest.reserved(rows, row.select("status", "idempotency_key"), A.as_of()).count() == 0


def test_reports(spark, sf_dir):
    assert [reports.bucket_days(x) for x in ("24h", "all", "nope", "12", None)] == [1, None, 30, 12, 30]
    e, a, s = A.events(spark, sf_dir), A.articles(spark, sf_dir), A.event_scores(spark, sf_dir)
    first = reports.event_list(reports.filtered_events(e, a, s, A.as_of()), s, a, A.as_of(), page=1, rows=5).collect()
    second = reports.event_list(reports.filtered_events(e, a, s, A.as_of()), s, a, A.as_of(), page=2, rows=5).collect()
    assert len(first) == len(second) == 5 and not {r.event_id for r in first} & {r.event_id for r in second}
    plan = reports.high_signal(e, s, a, A.as_of())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_upserts(spark):
    old = spark.createDataFrame([("rss", "u", "a", 1), ("rss", "v", "b", 1)], "t string, u string, name string, at int")
    new = spark.createDataFrame([("rss", "u", "c", 1), ("rss", "u", "d", 2)], old.schema)
    assert sorted((r.u, r.name) for r in health.upserted(old, new, ["t", "u"], "at").collect()) == [("u", "d"), ("v", "b")]


def test_streams(spark, tmp_path):
    land, table = f"{tmp_path}/land", f"{tmp_path}/table"
    schema = "canonical_url string, ingest_ts timestamp, published_at timestamp"
    at = datetime(2024, 1, 10)
    spark.createDataFrame([("u1", at, at), ("u2", at, at - timedelta(days=3)), ("u1", at, at)], schema).coalesce(1).write.mode("append").parquet(land)
    streams.append_new(streams.landed(spark, land, schema), table, f"{tmp_path}/c1", transform=streams.lateness).awaitTermination()
    spark.createDataFrame([("u2", at, at), ("u3", at, None)], schema).coalesce(1).write.mode("append").parquet(land)
    streams.append_new(streams.landed(spark, land, schema), table, f"{tmp_path}/c1", transform=streams.lateness).awaitTermination()
    got = sorted((r.canonical_url, r.too_old) for r in spark.read.parquet(table).collect())
    assert got == [("u1", False), ("u2", True), ("u3", False)]
    once = streams.without_redelivery(streams.landed(spark, land, schema))
    once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 3


def test_windows(spark, tmp_path, sf_dir):
    events = A.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(2).write.parquet(f"{tmp_path}/e")
    stream = streams.landed(spark, f"{tmp_path}/e", "ts timestamp, event_type string")
    streams.run_windows(stream).writeStream.format("memory").queryName("runs").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = {(r.w.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "2 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.started_at, r.event_type): r.n for r in spark.table("runs").collect()} == want


def test_event_states_across_batches(spark, tmp_path):
    schema = "event_id string, seq long, kind string, source_is_primary boolean, source_trust int, status string, confidence double"
    got = {}

    def keep(batch, _):
        got.update({r.seq: r.upgrade_reason for r in batch.collect()})

    batches = [
        [("e", 1, "article", False, 50, None, None), ("e", 2, "article", False, 20, None, None), ("e", 3, "verdict", None, None, "analyzed", 0.9)],
        [("e", 4, "article", False, 55, None, None), ("e", 5, "article", False, 70, None, None), ("e", 6, "article", True, 10, None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.event_states(streams.landed(spark, f"{tmp_path}/in", schema), expire=False)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(60)
        query.stop()
    assert got == {1: None, 2: "pending_event_new_evidence", 4: None, 5: "higher_trust_source", 6: "primary_source_discovered"}
