from collections import defaultdict

import corpus_pipeline
from signalflow.llm import exact_dedup, mixing, ngram_join, quality


def test_stages(spark, sf_dir, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        path = exact_dedup.new_path(spark, "test-stage")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    # The same by the operators' own results.
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    first = docs.where(docs.doc_id.isin(list(good)))
    unique = first.join(exact_dedup.exact_groups(first).where("kept").select("doc_id"), "doc_id", "left_semi")
    one = unique.join(ngram_join.link_classes(unique).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    copies = {r.doc_id: r.copies for r in mixing.mix(one).collect() if r.copies}
    starts = defaultdict(int)
    for r in packed:
        starts[r.doc_id] += r.piece == 0
    assert dict(starts) == copies


def test_stages_on_odd_and_empty_tables(spark, sf_dir, edge, empty):
    for table in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns
            out.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir)
        assert packed.where("piece = 0").count() == table.count()
