import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalflow.llm import resampling


@pytest.mark.parametrize("reach", [4, 5, 16, 64])
def test_position_crc_equals_crc32(reach):
    rng = np.random.default_rng(reach)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 2000, 1500), rng.integers(0, 2000, 1500)
    lengths[:700] %= 70
    found = resampling.PositionCrc(reach).of(data, starts, lengths)
    assert [int(x) for x in found] == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, n, buckets):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, percent=10):
    """(doc_id, n_features, weight, score, rank) by a loop over documents."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, n, buckets))
    for text in target:
        t.update(buckets_of(text, n, buckets))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        found = buckets_of(text, n, buckets)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20])
    eligible = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = rank
    return sorted(map(str, ((*r[:4], None if isinstance(r[4], bool) else r[4]) for r in rows)))


@pytest.mark.parametrize("n,percent", [(1, 10), (2, 50), (3, 100)])
def test_equals_a_loop_over_documents(spark, sf_dir, docs, n, percent):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resampling.resampled(docs, target, n=n, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in found) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r[0] for r in target.select("text").collect()], n, percent=percent)


def test_edge_rows(edge, empty):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    found = resampling.resampled(edge, edge.where("doc_id = 10"), percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows, [t for i, t in rows if i == 10], percent=50)
    assert resampling.resampled(empty, edge).count() == 0
    assert resampling.resampled(edge, empty).where("rank is not null").count() == 0  # ten percent of nine documents
    drawn = resampling.drawn_documents(edge, edge.where("doc_id = 10"), percent=100)
    assert drawn.columns == edge.columns and {r[0] for r in drawn.select("doc_id").distinct().collect()} == {7, 8, 9, 10, 11, 13, 15}


def test_ranks_of_a_score_that_most_rows_share(spark):
    rows = [(i % 700, 5 if i % 3 else random.Random(i).randrange(-(10**7), 10**7), i % 11 > 0) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean").repartition(7)
    found = resampling.ranked(resampling.saved(scored, "t"), 900)
    assert found.count() == 3000
    ranks = [tuple(r) for r in found.where("rank is not null").orderBy("rank").select("rank", "score", "doc_id").collect()]
    want = sorted(((s, i) for i, s, e in rows if e), key=lambda x: (-x[0], x[1]))[:900]
    assert ranks == [(k, s, i) for k, (s, i) in enumerate(want, 1)]
    assert found.where("rank is not null and not eligible").isEmpty() and resampling.ranked(scored.where(F.lit(False)), 5).isEmpty()


def test_long_texts_are_read_whole():
    texts = ["a b " * 3_000_000 + "end", None, "é" * 9000]
    seen = [(list(words), np.bincount(of, minlength=high - low).tolist()) for low, high, words, of, _ in resampling.hashed_features(pa.array(texts), 1, 97)]
    assert seen == [([6_000_001], [6_000_001]), ([0, 1], [0, 1])]
