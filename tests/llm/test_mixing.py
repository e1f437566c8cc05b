import re
from collections import defaultdict

from signalflow.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes):
    """Targets by repeated sharing of what is above the caps."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            open_.remove(s)
    return fixed


def check(frame, out):
    total, taken = defaultdict(int), defaultdict(int)
    for r in frame.select("doc_id", "text", "source").collect():
        total[r.source] += words(r.text)
    targets = fill(total)
    rows = out.collect()
    for r in rows:
        assert r.source_size == total[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    return targets, taken, rows


def test_targets_and_takes_on_documents(docs):
    targets, taken, rows = check(docs, mixing.mix(docs))
    assert len(rows) == docs.count()
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.02 * t + 30


def test_sources_come_within_one_percent(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets, taken, _ = check(frame, mixing.mix(frame))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.01 * t


def test_closing_reaches_what_sizes_allow(spark):
    """Hundreds of steps are open: no limit of rounds keeps a source from its target."""
    rows = [(i, "w " * (2 + i % 3), "a") for i in range(300)] + [(1000 + i, "w " * 997, "a") for i in range(3)] + [(2000 + i, "w " * (7 * i + 3), "b") for i in range(40)]
    rows += [(5000, "x y z", "b"), (5000, "x y z", "b")]  # rows that agree in everything
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets, taken, got = check(frame, mixing.mix(frame))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.001 * t + 1
    assert len({r.copies for r in got if r.doc_id == 5000}) == 1


def test_reruns_agree(docs):
    once, again = mixing.mix(docs), mixing.mix(docs.repartition(7))
    key = lambda d: sorted((r.doc_id, r.copies) for r in d.collect())
    assert key(once) == key(again)


def test_edge_cases(edge, empty):
    check(edge, mixing.mix(edge))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    assert {(r["size"], r["__sf_place"], r["__sf_copy"]) for r in mixed.collect()} <= {("clash", "own", "own")}


def test_capped_sources(spark):
    frame = spark.createDataFrame([(1, "a b", "a"), (2, "a " * 100, "b"), (3, None, "c"), (4, "x y z", None)], "doc_id int, text string, source string")
    targets, taken, _ = check(frame, mixing.mix(frame))
    assert targets["a"] == 6.0 and targets["c"] == 0.0 and taken["a"] == 6


def test_null_and_empty_sources_are_mixed_apart(spark):
    """The same ids and texts under source null and under source '': each is repeated as often as its own source takes it."""
    from collections import Counter

    rows = [(i, "a b c d", s) for i in range(4) for s in (None, "")] + [(i, "x y z w", "b") for i in range(8)] + [(9, "p|q r", "c|d"), (9, "d|p|q r", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    _, _, taken = check(frame, mixing.mix(frame))
    want = Counter()
    for r in taken:
        want[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixing.mixed_documents(frame).collect())
    assert got == +want and sum(n for (_, s), n in got.items() if s is None) != sum(n for (_, s), n in got.items() if s == "")
