from signalflow.plans import queries as plans


def test_identifiers_late_in_a_text_are_allowed(spark, tmp_path):
    """Generated text of document 4 names gpt-4; its title names gpt-0, its text gpt-4 far behind the beginning."""
    rows = [(4, "word " * 30 + "about gpt-4 here"), (24, "word " * 30), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.contradictions for r in plans.queries()["anchor_contradictions"](spark, str(tmp_path)).collect()}
    assert found == {4: "", 24: "subject:another,gpt-4", 9: "gpt-4"}
