import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalflow.operators import analysis
from signalflow.operators.snapshots import KeyedTable, keep_stored
from signalflow.streaming import streams

SCHEMA = "k string, n int, first int, total long, extra array<int>"
RULES = {"first": keep_stored, "total": lambda old, new: old + new}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k", "n"], buckets=5)
    assert table.rows().count() == 0 and table.versions() == []
    dice, want, states = random.Random(3), {}, []
    for number in range(4):
        rows = [(dice.choice([None, "", "a", "b", "c"]), dice.choice([None, 1, 2, 3]), number, dice.randint(1, 9), None if i % 3 else [i], i, "clash") for i in range(12 if number != 2 else 0)]
        table.apply(number, spark.createDataFrame(rows, SCHEMA + ", at int, old string"), ["at"], RULES)
        for key in {(r[0], r[1]) for r in rows}:
            last = [r for r in rows if (r[0], r[1]) == key][-1]
            before = want.get(key)
            want[key] = (before[0] if before else last[2], (before[1] if before else 0) + last[3], last[4])
        states.append(dict(want))
        got = {(r.k, r.n): (r.first, r.total, r.extra) for r in table.rows().collect()}
        assert got == want and table.rows().count() == len(want)
    # Earlier versions stay readable; a batch that was applied is not applied again.
    assert {(r.k, r.n): (r.first, r.total, r.extra) for r in table.rows(1).collect()} == states[1]
    table.apply(1, spark.createDataFrame([("z", 9, 9, 9, None)], SCHEMA), ["n"])
    assert table.rows().count() == len(want) and table.versions() == [0, 1, 2, 3]
    table.forget(keep=1)
    assert table.versions() == [3] and {(r.k, r.n) for r in table.rows().collect()} == set(want)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k int, v int", ["k"], buckets=8)
    table.apply(0, spark.range(200).selectExpr("cast(id as int) k", "0 v"), ["v"])
    table.apply(1, spark.createDataFrame([(7, 1)], "k int, v int"), ["v"])
    assert len([n for n in table._listed("data", 0) if "=" in n]) == 8 and len([n for n in table._listed("data", 1) if "=" in n]) == 1
    assert table.rows().agg(F.count("*"), F.sum("v")).first()[:] == (200, 1)


def test_alerts_are_reserved_once_though_a_batch_fails(spark, tmp_path):
    """The batch fails after its rows are written and before they count; then it runs again, and later batches bring the same events."""
    schema = "event_id string, text string"
    outbox = streams.outbox(spark, f"file://{tmp_path}/outbox")

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        query = streams.reserved(streams.landed(spark, f"{tmp_path}/in", schema, files_per_trigger=1), outbox, f"{tmp_path}/c")
        query.awaitTermination(60)

    land([("a", "one"), ("b", "two")])
    run()
    first = {r.event_id: r for r in outbox.rows().collect()}
    mark, outbox._mark = outbox._mark, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    land([("b", "other words"), ("c", "three"), ("c", "three")])
    with pytest.raises(Exception, match="lost"):
        run()
    assert {r.event_id: r for r in outbox.rows().collect()} == first
    outbox._mark = mark
    run()
    land([("a", "again")])
    run()
    got = {r.event_id: r for r in outbox.rows().collect()}
    assert outbox.rows().count() == 3 and got["c"].text == "three" and {k: got[k] for k in first} == first
    assert got["a"].alert_id == analysis.reserve_alerts(spark.createDataFrame([("a", "x")], schema), outbox.rows().limit(0)).first().alert_id
    # Outcomes are a table of their own; what has none is still to be sent, and a second outcome counts over the first.
    sent = streams.outcomes(spark, f"file://{tmp_path}/sent")
    sent.apply(0, spark.createDataFrame([(got["a"].alert_id, True, None, 1), (got["b"].alert_id, False, "x" * 300, 1)], "alert_id string, sent boolean, error_code string, attempt int"), ["attempt"])
    sent.apply(1, spark.createDataFrame([(got["b"].alert_id, True, None, 2)], "alert_id string, sent boolean, error_code string, attempt int"), ["attempt"])
    assert {r.event_id: r.delivery_status for r in analysis.delivered(outbox.rows(), sent.rows()).collect()} == {"a": "sent", "b": "sent", "c": "pending"}


def test_event_timelines_expire_by_event_time_and_survive_restarts(spark, tmp_path):
    schema = "event_id string, seq long, kind string, source_is_primary boolean, source_trust int, status string, confidence double, at timestamp"
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda d: datetime(2024, 3, 1) + timedelta(days=d)
    article = lambda e, seq, primary, trust, d: (e, seq, "article", primary, trust, None, None, day(d))
    batches = [
        [article("e", 1, False, 50, 0), article("e", 2, False, 20, 0), ("e", 3, "verdict", None, None, "analyzed", 0.9, day(1)), article("f", 4, False, 50, 0)],
        [article("e", 5, False, 70, 2), article("f", 6, True, 10, 13), (None, 7, "article", True, 1, None, None, day(1))],
        [article("g", 8, True, 10, 20)],  # passes day 16, when e is forgotten; f has its timer at day 27
        [article("e", 9, False, 5, 21)],  # e is new again
        [article("h", 10, True, 10, 60)],
    ]
    got = []
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = streams.event_timelines(streams.landed(spark, f"{tmp_path}/in", schema))
            query = stream.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination(120)
            query.stop()
    finally:
        spark.conf.set(store, before) if before is not None else spark.conf.unset(store)
    gone = "expired_without_verdict"
    want = [("e", 1, None), ("e", 2, "pending_event_new_evidence"), ("f", 4, None), ("e", 5, "higher_trust_source"), ("f", 6, "pending_event_new_evidence"), ("g", 8, None), ("e", 5, gone), ("e", 9, None), ("h", 10, None)]
    want += [("f", 4, gone), ("f", 6, gone), ("g", 8, gone), ("e", 9, gone)]
    assert sorted(got, key=str) == sorted(want, key=str)
