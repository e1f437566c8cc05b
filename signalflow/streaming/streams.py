"""Streams of landed candidates and events: the batch rules, applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analysis import reserve_alerts
from ..operators.snapshots import KeyedTable, Rule, keep_stored
from ..schemas import ALERT

#: Days after which a re-delivered item is no longer looked for in the stream's state (the tables still know it).
DEDUP_DAYS = 14
_FORGET_MS = DEDUP_DAYS * 24 * 3600 * 1000


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files that arrive under path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_redelivery(stream: DataFrame, key: str = "canonical_url", time: str = "ingest_ts") -> DataFrame:
    """Each key once within DEDUP_DAYS of the time column; state older than that is dropped."""
    return stream.withWatermark(time, f"{DEDUP_DAYS} days").dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, table: str, checkpoint: str, key: str = "canonical_url", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append rows whose key the table does not have, micro-batch by micro-batch, until the input is used up.

    Each batch writes its own folder (batch=N) and is compared with the folders of earlier batches, so a batch that runs again
    after a failure replaces what it wrote and adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = transform(batch) if transform else batch
        rows = rows.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            known = [s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
            earlier = [p for p in known if int(p.rsplit("=", 1)[1]) < number]
            if earlier:
                rows = rows.join(spark.read.schema(rows.schema).parquet(*earlier).select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lateness(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Rows with too_old: published so long before they came in. Late rows are marked, not dropped."""
    late = F.coalesce(F.col("published_at") < F.col("ingest_ts") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    return stream.withColumn("too_old", late)


def run_windows(stream: DataFrame, time: str = "ts", length: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Counts per run: tumbling windows of the time column."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("started_at"), "event_type", "n")


def rolling_counts(stream: DataFrame, time: str = "ts", length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of the last day, each hour anew: sliding windows."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, length, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.end").alias("as_of"), "n")


#: An event's state between batches, and that of one that no article has reached.
_STATE = "status string, primary boolean, trust int, verified boolean, confidence double"
_NEW_EVENT = ("new", False, -1, False, 0.0)


def _step(state: tuple, row: tuple) -> tuple[tuple, str | None]:
    """An event's state after an article or a verdict, and why an article is better evidence than all before it."""
    status, primary, trust, verified, confidence = state
    if row.kind == "verdict":
        return (row.status, primary, trust, verified, float(row.confidence)), None
    is_primary, its_trust = bool(row.source_is_primary), int(row.source_trust)
    reason = None
    if status == "new":
        status = "pending"
    elif status == "pending":
        reason = "pending_event_new_evidence"
    elif status == "analysis_failed" and is_primary:
        reason = "retry_failed_with_primary"
    elif is_primary and not verified:
        reason = "primary_source_discovered"
    elif its_trust >= trust + 10:
        reason = "higher_trust_source"
    elif confidence < 0.6 and (is_primary or its_trust > trust):
        reason = "low_confidence_better_evidence"
    primary, trust = max((primary, trust), (is_primary, its_trust))
    return (status, primary, trust, verified or is_primary, confidence), reason


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expire: bool) -> Iterator[pd.DataFrame]:
    """One event's new articles and verdicts, in their order."""
    if state.hasTimedOut:
        state.remove()
        return
    now, out = state.get if state.exists else _NEW_EVENT, []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
        now, reason = _step(now, r)
        if r.kind != "verdict":
            out.append((key[0], int(r.seq), reason))
    state.update(now)
    if expire:
        state.setTimeoutDuration(DEDUP_DAYS * 24 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["event_id", "seq", "upgrade_reason"])


def event_states(stream: DataFrame, expire: bool = True) -> DataFrame:
    """Why each article is better evidence than all before it for its event, with the event's status and best evidence kept
    between micro-batches and forgotten after DEDUP_DAYS without news. Use expire=False with the trigger availableNow, which
    would go on for ever to wait for the timeouts.

    stream: event_id, seq, kind (article or verdict), source_is_primary, source_trust, status, confidence. Returns event_id, seq
    and upgrade_reason of each article, null for an event's first.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return stream.groupBy("event_id").applyInPandasWithState(
        partial(_advance, expire=expire), "event_id string, seq long, upgrade_reason string", _STATE, "append", timeout
    )


class _Timeline(StatefulProcessor):
    """One event's state, the articles that no verdict has followed yet, and a timer at the day on which it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.last = handle.getValueState("last", "ms long")
        self.waiting = handle.getListState("waiting", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, out, waiting = self.state.get() if self.state.exists() else _NEW_EVENT, [], []
        batch = pd.concat(list(rows)).sort_values("seq")
        for r in batch.itertuples(index=False):
            now, reason = _step(tuple(now), r)
            if r.kind == "verdict":
                waiting = []
                self.waiting.clear()
            else:
                waiting.append((int(r.seq),))
                out.append((key[0], int(r.seq), reason))
        self.state.update(now)
        if waiting:
            self.waiting.appendList(waiting)
        before = self.last.get()[0] if self.last.exists() else None
        latest = max(int(t.timestamp() * 1000) for t in batch["at"])
        if before is None or latest > before:
            if before is not None:
                self.handle.deleteTimer(before + _FORGET_MS)
            self.handle.registerTimer(latest + _FORGET_MS)
            self.last.update((latest,))
        yield pd.DataFrame(out, columns=["event_id", "seq", "upgrade_reason"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        left = [(key[0], int(seq), "expired_without_verdict") for (seq,) in self.waiting.get()]
        for held in (self.state, self.last, self.waiting):
            held.clear()
        yield pd.DataFrame(left, columns=["event_id", "seq", "upgrade_reason"])

    def close(self) -> None:
        pass


def event_timelines(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """As event_states(), forgotten by the time of the events instead of the clock: DEDUP_DAYS after the latest row of an event, once the
    watermark (delay behind the latest row of all) has passed that. Articles that no verdict has followed by then come out once more, with
    the reason expired_without_verdict. A replay of old input so gives the same rows as its first run, also with the trigger availableNow.

    stream: the columns of event_states() and at (timestamp). Rows older than the watermark are left out. The session needs Spark's
    RocksDB state store (spark.sql.streaming.stateStore.providerClass), which keeps the state outside of the heap.
    """
    late = stream.withWatermark("at", delay).where("event_id is not null and at is not null")
    return late.groupBy("event_id").transformWithStateInPandas(_Timeline(), "event_id string, seq long, upgrade_reason string", "Append", "EventTime")


def upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, order: list[str], rules: dict[str, Rule] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Put the stream's rows into a stored table, until the input is used up. The table knows the micro-batches by their numbers, so one that
    runs again after a failure changes nothing twice; use one checkpoint for a table, and never start it anew."""

    def write(batch: DataFrame, number: int) -> None:
        table.apply(number, transform(batch) if transform else batch, order, rules)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outbox(spark: SparkSession, folder: str) -> KeyedTable:
    """The stored alerts: one for each event, type and channel."""
    return KeyedTable(spark, folder, ALERT, ["event_id", "alert_type", "channel"])


def outcomes(spark: SparkSession, folder: str) -> KeyedTable:
    """What became of alerts, by their ids; the latest attempt counts."""
    return KeyedTable(spark, folder, "alert_id string, sent boolean, error_code string", ["alert_id"])


def reserved(due: DataFrame, alerts: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Reserve an alert for each due event (a stream of event_id, text) that has none in the outbox. What is stored stays as it is, so an
    event is alerted once, however often it is due and its batch runs."""
    none = alerts.spark.createDataFrame([], ALERT)
    stay = {c: keep_stored for c in alerts.columns}
    return upserts(due, alerts, checkpoint, ["event_id"], stay, lambda batch: reserve_alerts(batch, none))
