"""The log of decisions and the record of a run: a run that is repeated replaces what it wrote, and its counters come from the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Decisions that go on to the analyzer; all others are discards.
KEPT = ("analyze", "pending_reanalysis", "evidence_reanalysis")
#: What a row of the log has of its analysis; null where there was none.
USAGE = "called boolean, retried boolean, error string, input_tokens long, output_tokens long, cost_micros long, alerted boolean"


def _is(decision: str) -> Column:
    return F.count_if(F.col("decision") == decision)


def counters() -> list[Column]:
    """A run's counters over its rows of the log."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [
        F.count("*").alias("collected"), F.count_if(F.col("seen_article").isNull()).alias("candidates_new"), _is("analyze").alias("prefilter_passed"),
        F.count_if((F.col("decision") == "analyze") & F.col("primary_bypass")).alias("primary_bypass_passed"), _is("pending_reanalysis").alias("pending_reanalysis"),
        _is("evidence_reanalysis").alias("evidence_reanalysis"), F.count_if(F.col("called") & F.col("error").isNull()).alias("analyzed"), F.count_if(F.col("called")).alias("llm_calls"),
        F.count_if(F.col("retried")).alias("analysis_retries"), F.count_if(F.col("alerted")).alias("alerts_sent"), total("input_tokens"), total("output_tokens"), total("cost_micros"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    ]


def write_log(decisions: DataFrame, folder: str) -> dict[str, int]:
    """Write rows (run_no, ordinal, decision, seen_article, primary_bypass and USAGE) to the log, and return the counters over all of them,
    observed while they are written.

    The log has a folder for each run; only those of the runs in decisions are replaced, once all tasks have ended, so a run that is
    repeated after a failure leaves one copy of its rows. Rows are brought together by run, large runs are split over tasks."""
    seen = Observation("counters")
    observed = decisions.observe(seen, *counters())
    observed.hint("rebalance", "run_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_no").parquet(folder + "/decisions")
    return seen.get


def write_record(spark: SparkSession, folder: str, run_no: int, counted: dict[str, int], call_limit: int) -> None:
    """The run's record, in place of an earlier one: its counters, its status and whether it reached the limit of calls."""
    row = {"run_no": run_no, **counted, "call_limit_reached": counted["llm_calls"] >= call_limit, "status": "completed_with_errors" if counted["errors"] else "completed"}
    kinds = ", ".join(f"{k} {'int' if k == 'run_no' else 'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'long'}" for k, v in row.items())
    spark.createDataFrame([tuple(row.values())], kinds).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_no").parquet(folder + "/runs")


def records(log: DataFrame, call_limit: int) -> DataFrame:
    """The records of all runs of a log, counted anew, with discards: how often each other decision was taken, by name."""
    by_decision = log.where(~F.col("decision").isin(*KEPT)).groupBy("run_no", "decision").agg(F.count("*").alias("n"))
    discards = by_decision.groupBy("run_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("discards"))
    counted = log.groupBy("run_no").agg(*counters()).join(discards, "run_no", "left")
    status = F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed")
    return counted.withColumns({"call_limit_reached": F.col("llm_calls") >= call_limit, "status": status, "discards": F.coalesce("discards", F.create_map().cast("map<string,bigint>"))})
