import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from signalflow.llm import exact_dedup, ngram_join, suffix_dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), keep is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_exact_groups(table, request):
    frame = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(frame).collect()), key=str)
    assert got == expected_groups(rows)


def test_without_copies_keeps_columns(edge):
    left = exact_dedup.without_copies(edge)
    assert left.columns == edge.columns and {(r["__sf_digest"], r["__sf_id"]) for r in left.collect()} == {("own", 7)}
    assert sorted(str(r.doc_id) for r in left.collect() if r.text == "one two") == ["5"]


def test_index_over_several_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    batch = lambda *x: spark.createDataFrame([(bytes([d]), i) for d, i in x], "digest binary, id long")
    index.flush(batch((1, 5), (2, 6)), "a")
    index.flush(batch((1, 3), (3, 9)), "b")
    index.flush(batch((1, 3), (3, 9)), "b")  # written again after a loss: counts once
    before = {bytes(r.digest): (r.rows, r.smallest, r.largest) for r in index.lookup(batch((1, 0)).select("digest")).collect()}
    assert before == {b"\x01": (2, 3, 5)}
    assert {bytes(r.digest): (r.rows, r.smallest, r.largest) for r in index.entries().collect()} == {b"\x01": (2, 3, 5), b"\x02": (1, 6, 6), b"\x03": (1, 9, 9)}


def test_levels_keep_all_entries(spark, monkeypatch):
    """Many batches, compacted in between, with memtables that are full after a few rows."""
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 3)
    index, want = exact_dedup.DigestIndex(spark), {}
    for k in range(9):
        rows = [(bytes([(k * 5 + j) % 11]), k * 10 + j) for j in range(8)] + [(b"x", None)]
        index.flush(spark.createDataFrame(rows, "digest binary, id long").coalesce(2), f"batch{k}")
        index.compact()
        for d, i in rows:
            n, ids = want.get(d, (0, []))
            want[d] = (n + 1, ids + [i] * (i is not None))
    assert [len(level) for level in index.levels] == [1, 2]
    got = {bytes(r.digest): (r.rows, r.smallest, r.largest) for r in index.entries().collect()}
    assert got == {d: (n, min(ids, default=None), max(ids, default=None)) for d, (n, ids) in want.items()}


def test_memtables_flush_sorted_runs():
    batch = pa.RecordBatch.from_arrays([pa.array([b"b", b"a", b"b", b"c"]), pa.array([4, 3, 2, None])], names=["digest", "id"])
    runs = [b.to_pylist() for b in exact_dedup._memtables(iter([batch, batch, batch]), 8)]
    assert [[r["digest"] for r in run] for run in runs] == [[b"a", b"b", b"c"]] * 2
    assert runs[0][1] == {"digest": b"b", "rows": 4, "smallest": 2, "largest": 4} and runs[1][2] == {"digest": b"c", "rows": 1, "smallest": None, "largest": None}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """Smallest id by links between all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            c = len(x & y)
            if 100 * c >= 80 * (len(x) + len(y) - c):
                label[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted(((i, len(x), smallest.get(find(k)) if i is not None else None) for k, (i, x) in enumerate(sets)), key=str)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_link_classes(table, request):
    frame = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(frame).collect()), key=str)
    assert got == brute_classes(rows)


def test_chains_stars_and_near_misses(spark):
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(60):  # each differs from the base in its own places; neighbours differ more than base and copy
        w = base.copy()
        for j in range(k % 7):
            w[(k * 11 + j * 17) % 120] = f"r{k}x{j}"
        rows.append((k, " ".join(w)))
    for k in range(40):  # a chain
        rows.append((100 + k, " ".join(f"c{i}" for i in range(k * 4, k * 4 + 80))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(frame).collect()), key=str)
    assert got == brute_classes(rows)


def test_one_of_each_class(edge):
    left = ngram_join.one_of_each_class(edge)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == edge.columns and 8 in ids and not {9, 10, 11, 15} & set(ids)


def brute_spans(rows, n=50):
    words = defaultdict(set)
    for i, t in rows:
        if i is not None:
            words[i].add((t or "").encode())
    seen = defaultdict(set)
    for i, texts in words.items():
        for t in texts:
            w = t.split()
            for j in range(len(w) - n + 1):
                seen[tuple(w[j : j + n])].add(i)
    out = []
    for i, texts in words.items():
        for t in texts:
            w, run = t.split(), None
            for j in range(len(w) - n + 1):
                if len(seen[tuple(w[j : j + n])]) > 1:
                    if run and run[1] == j - 1:
                        run[1] = j
                    else:
                        run = [j, j]
                        out.append((i, run))
    return sorted((i, a, b + n) for i, (a, b) in out)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_repeated_passages(table, request):
    frame = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(frame).collect())
    assert got == brute_spans(rows)


def test_passages_with_different_surroundings(spark):
    passage = [f"p{i}" for i in range(90)]
    rows = [
        (1, " ".join(["a"] * 40 + passage + ["b"] * 40)), (2, " ".join(["c"] * 10 + passage[:60])), (3, " ".join(passage[35:] + ["d"] * 5)), (4, " ".join(passage[:49])),
        (5, " ".join(["e"] * 200)), (6, " ".join(["e"] * 70 + ["f"])),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(frame).collect())
    assert got == brute_spans(rows)


def test_positions_in_very_long_texts():
    """The smallest of 32 neighbours is found beyond 2**24 words, and the leftmost of equals."""
    n = (1 << 24) + 400
    grams = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5DEECE66D)
    grams[n - 200 : n - 150] = 7
    chosen, begin, count = suffix_dedup._runs(grams, np.array([0, n]))
    tail = begin >= n - 400
    for c, b, k in zip(chosen[tail], begin[tail], count[tail]):
        for at in (b, b + k - 1):
            assert c == at + int(np.argmin(grams[at : at + 32]))
    assert count.sum() == n - 31 and chosen.max() > 1 << 24


@pytest.mark.parametrize("block, task", [(2, 2), (5, 1), (128, 32)])
def test_blocks_of_lists_skip_no_pair(spark, monkeypatch, block, task):
    """Long and short lists, large and small labels: whatever the blocks, all pairs within the bounds meet."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCKS_A_TASK", task)
    rng = np.random.default_rng(5)
    size, label = rng.integers(4, 80, 60), rng.integers(0, 12, 60) % 7
    rows = []
    for token, share in ((1, 1.0), (2, 0.5), (3, 0.1), (4, 0.1)):
        for i in np.flatnonzero(rng.random(60) < share):
            n = int(size[i])
            rows.append((token, int(i), n, int(rng.integers(0, n - -(-80 * n // 100) + 1)), int(label[i])))
    want = set()
    for t, i, n, at, a in rows:
        for t2, j, n2, at2, b in rows:
            need = -(-80 * (n + n2) // 180)
            if t == t2 and i < j and a != b and min(n, n2) >= need and min(n - at, n2 - at2) >= need:
                want.add((i, j))
    mixed = spark.createDataFrame(rows, "token long, set long, n int, at int, label long")
    got = [tuple(r) for r in ngram_join._met(mixed, 80).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_long_lists_go_last(spark, monkeypatch):
    """A passage that one text of each batch holds is found by its long lists; classes stay right."""
    monkeypatch.setattr(ngram_join, "FREQUENT_COUNT", 6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(70)) + " " + passage) for i in range(30)] + [(100, passage + " end"), (101, passage)]
    rows += [(i + 200, t + " more") for i, t in rows[:10]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(frame).collect()), key=str) == brute_classes(rows)
