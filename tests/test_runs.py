from pyspark.sql import functions as F

from signalflow.plans import runs

SCHEMA = "run_no int, ordinal long, decision string, seen_article long, primary_bypass boolean, " + runs.USAGE


def rows(run, n):
    kinds = ["analyze", "duplicate", "pending_reanalysis", "too_old"]
    return [(run, i, kinds[i % 4], None if i % 3 else 1, i % 8 == 0, i % 4 in (0, 2), i == 0, "bad" if i == 2 else None, 10 if i % 2 == 0 else None, i if i % 2 == 0 else None, 5 if i % 2 == 0 else None, i == 4) for i in range(n)]


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    runs.write_log(spark.createDataFrame(rows(1, 3), SCHEMA), folder)
    runs.write_log(spark.createDataFrame(rows(2, 9), SCHEMA), folder)
    counted = [runs.write_log(spark.createDataFrame(rows(1, 8), SCHEMA).repartition(3), folder) for _ in range(2)][-1]
    log = spark.read.parquet(folder + "/decisions")
    assert {r.run_no: r["count"] for r in log.groupBy("run_no").count().collect()} == {1: 8, 2: 9}
    want = {"collected": 8, "candidates_new": 5, "prefilter_passed": 2, "primary_bypass_passed": 1, "pending_reanalysis": 2, "evidence_reanalysis": 0, "analyzed": 3, "llm_calls": 4, "analysis_retries": 1}
    want |= {"alerts_sent": 1, "input_tokens": 40, "output_tokens": 12, "cost_micros": 20, "errors": 1}
    assert counted == want
    anew = runs.records(log, 4).where("run_no = 1").first().asDict()
    assert {k: anew[k] for k in want} == want and anew["discards"] == {"duplicate": 2, "too_old": 2} and anew["call_limit_reached"]
    for _ in range(2):
        runs.write_record(spark, folder, 1, counted, 5)
    record = spark.read.parquet(folder + "/runs").collect()
    assert len(record) == 1 and record[0].status == "completed_with_errors" and not record[0].call_limit_reached and record[0].llm_calls == 4
    assert runs.write_log(log.where(F.lit(False)), folder)["collected"] == 0 and spark.read.parquet(folder + "/decisions").count() == 17
