"""Packing documents into sequences of bounded length by patterns of few lengths, fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches
from .tokens import tokenizer

#: Tokens in a sequence, and the id that ends each document.
LENGTH, END_ID = 1024, 2
#: Gradient steps of the fit of patterns, which have up to three pieces.
FIT_STEPS = 600

PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, with their rank among this task's pieces of equal length."""
    enc, part = tokenizer(path), TaskContext.get().partitionId()
    end = np.array([end_id], np.dtype("<u4")).tobytes()
    seen = np.zeros(length + 1, np.int64)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 500):
            rows: list[tuple] = []
            for doc, data in zip(ids[at : at + 500], map(enc.encode, texts[at : at + 500])):
                data += end
                total = len(data) // 4
                count = -(-total // length)
                first = total - (count - 1) * length
                begin = 0
                for k in range(count):
                    n = first if k == 0 else length
                    part_ids = data[4 * begin : 4 * (begin + n)]
                    rows.append((part, doc, k, begin, n, zlib.crc32(part_ids), seen[n], part_ids) if keep_ids else (part, doc, k, begin, n, zlib.crc32(part_ids), seen[n]))
                    seen[n] += 1
                    begin += n
            if rows:
                names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"] + ["ids"] * keep_ids
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def _pieces_alone(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """_pieces, leaving no memory behind in the worker when the task ends."""
    try:
        yield from _pieces(batches, path, length, end_id, keep_ids)
    finally:
        tokenizer(path).forget()
        pa.default_memory_pool().release_unused()


def length_patterns(length: int) -> np.ndarray:
    """All multisets of 1 to 3 lengths that fill a sequence exactly, as rows padded with 0, largest first."""
    one = [(length, 0, 0)]
    two = [(length - b, b, 0) for b in range(1, length // 2 + 1)]
    three = [(length - b - c, b, c) for c in range(1, length // 3 + 1) for b in range(c, (length - c) // 2 + 1)]
    return np.array(one + two + three, np.int64)


def fit_patterns(histogram: np.ndarray, patterns: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squared distance between the histogram (index: length) and the
    pieces that x patterns use: accelerated projected gradient steps, starting from zero. Short pieces weigh less, since
    they fit in anywhere. Patterns with a length that does not occur stay at zero."""
    length = len(histogram) - 1
    usable = np.all((patterns == 0) | (histogram[patterns] > 0), axis=1)
    p = patterns[usable]
    if not len(p):
        return np.zeros(len(patterns))
    scale = max(1.0, float(histogram.max()))
    weight = np.where(np.arange(length + 1) < length / 16, 0.2, 1.0)
    weight[0] = 0.0
    target = histogram / scale
    # A bound of the largest eigenvalue of A' W A: largest row sum of A'WA over the patterns.
    uses = np.bincount(p.ravel(), minlength=length + 1).astype(float)
    uses[0] = 0.0
    step = 1.0 / max(1e-9, float((uses[p] * weight[p]).sum(axis=1).max()))
    x = np.zeros(len(p))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        have = np.bincount(p.ravel(), weights=np.repeat(y, 3), minlength=length + 1)
        gradient = ((have - target) * weight)[p].sum(axis=1)
        nx = np.maximum(0.0, y - step * gradient)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nx + (t - 1) / nt * (nx - x)
        x, t = nx, nt
    out = np.zeros(len(patterns))
    out[usable] = x * scale
    return out


def _best_fit(left: np.ndarray, plan: dict[tuple[int, ...], int]) -> None:
    """Add to plan what packs the counts in left best-fit, longest first, with open sequences as counts by what they hold."""
    length = len(left) - 1
    room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(free: int, held: tuple[int, ...], times: int) -> None:
        same = room.setdefault(free, {})
        same[held] = same.get(held, 0) + times

    for n in np.flatnonzero(left)[::-1].tolist():
        many = int(left[n])
        while many:
            free = min((r for r in room if r >= n), default=None)
            if free is None:
                full, rest = divmod(many, length // n)
                if full:
                    put(length - length // n * n, (n,) * (length // n), full)
                if rest:
                    put(length - rest * n, (n,) * rest, 1)
                break
            held, count = next(iter(room[free].items()))
            take = min(count, many)
            if take < count:
                room[free][held] = count - take
            elif len(room[free]) > 1:
                del room[free][held]
            else:
                del room[free]
            put(free - n, (*held, n), take)
            many -= take
    for same in room.values():
        for lengths, times in same.items():
            plan[lengths] = plan.get(lengths, 0) + times


def plan_packing(histogram: np.ndarray, steps: int = FIT_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """How to pack pieces of the given histogram (index: length, from 1 to the sequence length): (lengths, repeats).

    Pieces of the full length stand alone. For the others, pattern counts are fitted and rounded: up where their fraction
    is above a bound, else down, and never to more pieces than there are; what remains is packed best-fit. Of
    several bounds the plan with the fewest sequences is used. Works on the histogram only, so it costs the same for any number of pieces. All pieces are
    packed.
    """
    length = len(histogram) - 1
    rest = histogram.astype(np.int64).copy()
    full = {(length,): int(rest[length])} if rest[length] else {}
    rest[length] = 0
    patterns = length_patterns(length)[1:]
    x = fit_patterns(rest.astype(float), patterns, steps) if rest.any() else np.zeros(len(patterns))
    plans = []
    for bound in (1.0, 0.75, 0.5, 0.25):
        plan, left = dict(full), rest.copy()
        counts = np.floor(x + 1 - bound).astype(np.int64)
        for i in sorted(np.flatnonzero(counts), key=lambda i: -x[i]):
            parts, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = int(min(counts[i], (left[parts] // times).min()))
            if n > 0:
                lengths = tuple(int(v) for v in patterns[i] if v)
                plan[lengths] = plan.get(lengths, 0) + n
                left[parts] -= n * times
        _best_fit(left, plan)
        plans.append(plan)
    return list(min(plans, key=lambda p: sum(p.values())).items())


def slots(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where pieces go: for each length, runs of ranks from rank_from on; the piece of rank r in a run goes to sequence
    first_sequence + r - rank_from, at the run's offset."""
    rows, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "first_sequence", "offset"])


def _placed(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column("rank")).astype(np.int64)
        run = np.searchsorted(table["key"], (length << 50) + rank, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(table["first_sequence"][run] + rank - table["rank_from"][run]), pa.array(table["offset"][run])],
            names=[*batch.schema.names[:-1], "sequence_id", "offset"],
        )


def pack(documents: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most length tokens.

    A document is its token ids and then end_id. Longer ones are cut into pieces of length tokens, of which the first may
    be shorter. The histogram of piece lengths (at most length counts, on the driver) decides the plan; each piece finds its
    slot by its rank among the pieces of its length, which is the rank within its task plus the pieces of earlier tasks.
    No piece meets others in a task because of its length, so a length that a third of all pieces have is no hot spot.

    documents: doc_id (integer), text. Null and empty texts give one piece of end_id alone; rows that repeat a
    doc_id are packed each; a null doc_id stays null; an empty table gives no rows; other columns are ignored. Returns
    doc_id, piece (from 0), start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), sequence_id, offset, and
    with keep_ids also ids (binary, as for ids_crc32). keep_words: whether a Python worker's cache of words stays for its next task,
    which saves time; without it, jobs that follow find the memory free.
    """
    small_batches(documents.sparkSession)
    schema = PIECES + (", ids binary" if keep_ids else "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(partial(_pieces if keep_words else _pieces_alone, path=tokenizer_path, length=length, end_id=end_id, keep_ids=keep_ids), schema)
    pieces = saved(cut, "pieces")
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        histogram[r["length"]] = r["n"]
    table = slots(plan_packing(histogram)).sort_values(["length", "rank_from"], kind="stable")
    known = {c: table[c].to_numpy(np.int64) for c in table.columns}
    known["key"] = (known["length"] << 50) + known["rank_from"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ids = ["ids"] if keep_ids else []
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *ids, (F.col("rank") + F.col("base")).alias("rank")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, table=known), out)
