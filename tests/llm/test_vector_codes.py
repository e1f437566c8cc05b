import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, parts string, __label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same by loops over Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda i: (i is None, i or 0)
    first = min(((order(i), len(v)) for i, v, _ in kept if v and len(v) % parts == 0), default=None)
    n = first[1] if first else 0
    able = [(i, [v[p * n // parts : (p + 1) * n // parts] for p in range(parts)], label) for i, v, label in kept if n and len(v) == n]
    seeds = {}
    for i, v, _ in able:
        seeds[order(i)] = min(v, seeds.get(order(i), v))
    seeds = [seeds[k] for k in sorted(seeds)[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: gap(x, book[e]))
    for _ in range(rounds):
        groups = [[[] for _ in book] for book in books]
        for _, v, _ in able:
            for p in range(parts):
                groups[p][near(v[p], books[p])].append(v[p])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else book[e] for e, g in enumerate(gs)] for book, gs in zip(books, groups, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in able:
        codes = [near(v[p], books[p]) for p in range(parts)]
        error = sum(gap(v[p], books[p][c]) for p, c in enumerate(codes))
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in codes), min(error, 2**63 - 1), label))
    out += [(i, None, None, label) for i, v, label in kept if len(v) != n]
    return sorted(str((i, c, e, min(sums[label], 2**63 - 1) if label in sums else None, digest)) for i, c, e, label in out)


def found(table, **options):
    return sorted(str(tuple(r)) for r in vector_codes.compressed(table, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_equals_loops_on_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert found(table) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    assert found(table.repartition(5), entries=3, rounds=1) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()], entries=3, rounds=1)


@pytest.mark.parametrize("large", [None, 3e7, 1e12])
def test_edge_rows(spark, large):
    rng = np.random.default_rng(5)
    values = rng.normal(0, 0.1, (40, 16)).astype(np.float32).tolist()
    rows = [(i, v, None if i % 4 == 0 else i % 3) for i, v in enumerate(values)]
    rows += [rows[7]] * 30 + [(3, values[9], 1), (None, values[5], 2), (None, None, 2), (50, None, 1), (51, [*values[0][:15], None], 1)]
    rows += [(52, [*values[0][:15], math.nan], 1), (53, [math.inf, *values[0][:15]], 1), (54, [], 1), (55, values[0][:8], 9), (-1, values[0][:5], 2)]
    if large:
        rows.append((56, [float(np.float32(large)), *values[0][1:]], 2))
    table = spark.createDataFrame([(*r, *["own"] * 4) for r in rows], SCHEMA).repartition(3)
    assert found(table) == plain(rows)
    assert found(table.where("vec_id in (1, 2)"), entries=16) == plain([r for r in rows if r[0] in (1, 2)])
    assert found(table.where(F.lit(False))) == [] == found(table.where("embedding is null"))


@pytest.mark.parametrize("spread", [1, 30, 3000])
def test_memo_gives_the_nearest_entries(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread * 10, spread * 10, (16, 8))
    book[9] = book[2]
    x = (book[rng.integers(0, 16, 6000)] + rng.normal(0, spread, (6000, 8))).astype(np.int64)
    memo = vector_codes.CellMemo(book)
    gaps = ((x[:, None, :] - book[None]) ** 2).sum(2)
    for low in range(0, 6000, 500):
        best, least = memo.nearest(x[low : low + 500])
        assert (best == gaps[low : low + 500].argmin(1)).all() and (least == gaps[low : low + 500].min(1)).all()
    assert memo.compared < 0.5 * 16 * memo.rows  # most entries are left out


def test_cells_of_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(0)
    book, x = rng.integers(-500, 500, (16, 4)), rng.integers(-900, 900, (3000, 4))
    memo = vector_codes.CellMemo(book)
    memo.factors = np.array([0, 0, 0, 1])
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", 20)
    for part in np.array_split(x, 30):
        assert (memo.nearest(part)[0] == ((part[:, None, :] - book[None]) ** 2).sum(2).argmin(1)).all()
