import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from signalflow.operators import intervals, terms


@pytest.mark.parametrize("block", [100_000, 7])
def test_terms_equal_a_search_for_each(spark, block):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ab é😀") for _ in range(rng.randrange(n)))
    texts = [(i, draw(60)) for i in range(200)] + [(200, None), (201, "")]
    words = [(draw(5), f"{rng.randrange(50) / 1000:.4f}") for _ in range(80)] + [("", "0.0017"), (None, "9"), ("ab", "0.0001"), ("ab", "0.0002"), ("é😀", "3")]
    table = spark.createDataFrame(words, "term string, weight string").withColumn("weight", F.col("weight").cast("decimal(10,4)"))
    got = {r.id: (r.n_terms, r.keyword_score) for r in terms.term_scores(spark.createDataFrame(texts, "id long, text string"), table, block).collect()}
    total = {}
    for t, w in words:
        if t is not None:
            total[t] = total.get(t, Decimal(0)) + Decimal(w)
    for i, text in texts:
        hits = [t for t in total if text is not None and t in text]
        assert got[i] == (len(hits), min(100, round(sum((total[t] for t in hits), Decimal(0)) * 30))), text
    assert terms.term_scores(spark.createDataFrame(texts, "id long, text string"), table.where("false")).agg(F.sum("n_terms")).first()[0] == 0


def test_recent_rows_equal_all_pairs(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    time = lambda: None if rng.random() < 0.05 else start + timedelta(seconds=rng.randrange(40 * 86_400) // 3600 * 3600)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), time()) for i in range(300)]
    before = [(i, rng.choice([None, "a", "a", "b"]), time()) for i in range(200)] + [(900, "b", datetime(1969, 12, 31, 23)), (901, "b", start)]
    rows += [(700, "b", datetime(1970, 1, 2)), (701, "b", start + timedelta(days=7)), (702, "b", start + timedelta(days=7, seconds=1))]
    joined = intervals.with_recent(spark.createDataFrame(rows, "id int, k string, at timestamp"), spark.createDataFrame(before, "other int, k string, seen timestamp"), ["k"], "at", "seen", 7)
    want = {(i, j) for i, k, t in rows for j, k2, s in before if k is not None and k == k2 and t and s and s <= t <= s + timedelta(days=7)}
    assert sorted((r.id, r.other) for r in joined.collect()) == sorted(want) and (701, 901) in want and (700, 900) in want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        intervals.with_recent(joined, joined, ["k"], "at", "seen", 0)
