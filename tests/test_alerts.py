from datetime import datetime

from pyspark.sql import functions as F

from signalflow.operators import analysis
from signalflow.plans import alerts


def test_message_of_an_alert(spark):
    events = spark.createDataFrame(
        [("e", "A <b> & c", 0.8, 0.25, False, True, "http://x/?a=1&b=2", "it's", None), ("none", "t", 0.1, 0.1, True, False, "u", "w", "y")],
        "event_id string, title string, confidence double, hype double, source_is_primary boolean, source_requires_primary boolean, canonical_url string, what_happened string, why_it_matters string",
    )
    scores = spark.createDataFrame(
        [("e", 2, "B", "Two", 70, 95, None, "r2"), ("e", 1, "A", "One", 60, 90, None, "r<1"), ("e", 3, "C", "Three", 50, 95, "", None)],
        "event_id string, profile_id int, icon string, name string, relevance_score int, alert_score int, suggested_action string, reason string",
    )
    ((event, text),) = alerts.alert_messages(events, scores).collect()
    assert event == "e" and text.split("\n\n") == [
        "<b>ALERT 95/100</b>", "<b>A &lt;b&gt; &amp; c</b>\nConfidence: 0.80\nHype: 0.25\n" + alerts.UNVERIFIED, "B <b>Two</b>\nRelevance: 70\nAlert: 95", "C <b>Three</b>\nRelevance: 50\nAlert: 95",
        "A <b>One</b>\nRelevance: 60\nAlert: 90", "<b>WHAT HAPPENED</b>\nit&#x27;s", "<b>WHY IT MATTERS</b>", "\n<b>REASONS</b>\n• One: r&lt;1\n• Two: r2\n• Three: ", "<b>SUGGESTED ACTION</b>\n" + alerts.NO_ACTION,
        '<a href="http://x/?a=1&amp;b=2">Source</a>',
    ]


def test_decisions_are_appended_by_day(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for day, n in ((1, 3), (2, 2), (2, 1)):
        rows = spark.range(n).withColumn("decision", F.lit("analyze"))
        alerts.append_decisions(rows, path, F.lit(datetime(2024, 1, day, 12)))
    log = spark.read.parquet(path)
    assert {str(r.day): r["count"] for r in log.groupBy("day").count().collect()} == {"2024-01-01": 3, "2024-01-02": 3}


def test_analyzer_is_a_function_of_requests(spark):
    candidates = spark.createDataFrame([(f"e{i}", f"title {i}", "s", "n", None, i) for i in range(4)], "event_id string, title string, summary string, source_name string, published_at timestamp, ordinal long")
    requests = analysis.requests(analysis.within_call_cap(candidates, 3), [(1, "p", "P", "*", True, [1])])
    assert requests.count() == 3

    def analyzer(asked):
        body = '{"subject_name":"x","profiles":[],"summary":"s"}'
        content = F.when(F.col("event_id") == "e1", "broken").otherwise(body)
        return asked.where("event_id <> 'e2'").select("event_id", F.lit('{"prompt_tokens":3}').alias("usage"), content.alias("content"))

    got = {r.event_id: r.error for r in alerts.analyzed(requests, analyzer, analysis.parsed).collect()}
    assert got == {"e0": None, "e1": "analysis_failed", "e2": "no_response"}
