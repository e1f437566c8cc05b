"""Vector code compression: product codes by exact nearest entries, which a memo of grid cells narrows down."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small, small_batches

#: Whole numbers per unit of a component, parts of a vector, entries of a part's codebook, and rounds that replace entries.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Magnitude up to which squares and sums of a batch fit 64 bits; batches with larger components are worked on with Python's integers.
PLAIN = 1 << 26
#: Cells that a task remembers for a part; beyond them it starts its memo anew, which costs time only.
MEMO_CELLS = 1 << 16
_LONGEST = (1 << 63) - 1


class CellMemo:
    """Nearest entries of one part's codebook, exactly.

    A grid with cells of 2**shift on each axis covers the part's space. For a cell that is seen first, the least and the greatest
    distance of each entry to the cell's box are found; an entry whose least distance is above another's greatest can't be nearest
    for anything in the box, and the others are remembered under a hash of the cell's coordinates. Vectors are then compared with
    these entries only. Two cells of one hash are told apart by their coordinates: the later one is compared with all entries."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        gaps = ((book[:, None, :] - book[None, :, :]).astype(float) ** 2).sum(2)
        near = np.sort(gaps, 1)[:, 1:2]  # next entries; none if there is one entry
        side = float(np.sqrt(np.median(near) / book.shape[1])) if near.size else 0.0
        self.shift = max(0, int(np.log2(side))) if side >= 1 else 0
        self.factors = np.random.default_rng(11).integers(1, 1 << 62, book.shape[1]) | 1
        self.clear()
        self.compared = self.rows = 0

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.cells = np.empty((0, self.book.shape[1]), np.int64)
        self.masks = np.empty((0, len(self.book)), bool)

    def _masks(self, cells: np.ndarray) -> np.ndarray:
        low = cells << self.shift
        high = low + ((1 << self.shift) - 1)
        book = self.book[None, :, :]
        out = np.maximum(np.maximum(low[:, None, :] - book, book - high[:, None, :]), 0)
        far = np.maximum(abs(book - low[:, None, :]), abs(book - high[:, None, :]))
        return (out * out).sum(2) <= (far * far).sum(2).min(1)[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each row's nearest entry, ties to the lower index."""
        if x.dtype == object:
            gaps = ((x[:, None, :] - self.book.astype(object)[None, :, :]) ** 2).sum(2)
            best = np.array([min(range(len(g)), key=g.__getitem__) for g in gaps.tolist()], np.int64)
            return best, gaps[np.arange(len(x)), best]
        cells = x >> self.shift
        keys, first, inverse = np.unique((cells * self.factors).sum(1), return_index=True, return_inverse=True)
        if len(self.place) + len(keys) > MEMO_CELLS:
            self.clear()
        new = [i for i, k in enumerate(keys.tolist()) if k not in self.place]
        if new:
            self.place |= {int(keys[i]): len(self.cells) + j for j, i in enumerate(new)}
            self.cells = np.concatenate([self.cells, cells[first[new]]])
            self.masks = np.concatenate([self.masks, self._masks(cells[first[new]])])
        at = np.array([self.place[k] for k in keys.tolist()], np.int64)[inverse]
        left = self.masks[at] | (self.cells[at] != cells).any(1)[:, None]
        row, entry = np.nonzero(left)
        gaps = ((x[row] - self.book[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(gaps, starts)
        hits = np.flatnonzero(gaps == least[row])
        self.compared += len(row)
        self.rows += len(x)
        return entry[hits[np.searchsorted(row[hits], np.arange(len(x)))]], least


def _memos(books: np.ndarray) -> list[CellMemo] | None:
    return [CellMemo(book) for book in books] if _fits(books) else None


def _fits(x: np.ndarray) -> bool:
    return not x.size or (x.min() >= -PLAIN and x.max() <= PLAIN)


def _assigned(column: pa.Array, books: np.ndarray, memos: list[CellMemo] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's vectors (rows, parts, width) with the index and the squared distance of each part's entry."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(books), -1)
    if memos is None or not _fits(x):
        x, memos = x.astype(object), [CellMemo(book) for book in books.astype(object)] if memos is None else memos
    found = [memo.nearest(x[:, p]) for p, memo in enumerate(memos)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task's parts add to each entry's sums: one row for each part, entry and position."""
    parts, entries, width = books.shape
    memos = _memos(books)
    total, count = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
    for batch in batches:
        if batch.num_rows:
            x, codes, _ = _assigned(batch.column(0), books, memos)
            for p in range(parts):
                own = np.zeros((entries, width), x.dtype)
                np.add.at(own, codes[:, p], x[:, p])
                total[p] += own.astype(object)
                count[p] += np.bincount(codes[:, p], minlength=entries)
    used = np.argwhere(np.broadcast_to(count[:, :, None] > 0, books.shape))
    columns = [pa.array(used[:, i].astype(np.int32)) for i in range(3)]
    sums = pa.array([Decimal(int(total[tuple(i)])) for i in used], pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([*columns, sums, pa.array(count[used[:, 0], used[:, 1]])], ["part", "entry", "position", "total", "n"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    memos = _memos(books)
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])], object)
    for batch in batches:
        if batch.num_rows:
            _, codes, gaps = _assigned(batch.column(2), books, memos)
            written = digits[codes].sum(1)
            error = [min(int(e), _LONGEST) for e in gaps.astype(object).sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(written, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def _smallest(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """A task's smallest distinct ids, nulls last, each with its smallest vector."""
    best: dict = {}
    kind = None
    for batch in batches:
        kind = batch.schema
        ids = batch.column(0).to_pylist()
        top = set(sorted({(i is None, i if i is not None else 0) for i in ids} | set(best))[:entries])
        rows = [j for j, i in enumerate(ids) if (i is None, i if i is not None else 0) in top]
        for j in rows:
            key, vector = (ids[j] is None, ids[j] if ids[j] is not None else 0), batch.column(1)[j].as_py()
            best[key] = min(vector, best.get(key, vector))
        best = {k: best[k] for k in sorted(best)[:entries]}
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array([None if k[0] else k[1] for k in best], kind.field(0).type), pa.array(list(best.values()), pa.list_(pa.int64()))], ["vec_id", "parts"])


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and parts: each component x as floor(scale * x), of rows whose vector is not null and has finite components only."""
    number = lambda x: x.cast("double")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    kept = table.where(F.col("embedding").isNotNull() & ~odd)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(number(x) * scale).cast("long")).alias("parts"))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The final codebooks (parts, entries, width) of vectors of one length. Each round is one pass: tasks add up their own parts, and one
    number for each part, entry, position and task is shuffled. Only codebooks come to the driver."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    firsts = vectors.select("vec_id", "parts").mapInArrow(partial(_smallest, entries=entries), f"vec_id {kind}, parts array<long>")
    first = firsts.groupBy("vec_id").agg(F.min("parts").alias("parts")).orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    seeds = np.array([r["parts"] for r in first], np.int64)
    books = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = vectors.select("parts").mapInArrow(partial(_sums, books=books), "part int, entry int, position int, total decimal(38,0), n long")
        new = books.copy()
        for part, entry, position, total, n in sums.groupBy("part", "entry", "position").agg(F.sum("total"), F.sum("n")).collect():
            new[part, entry, position] = int(total) // n
        books = new
    return books


def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Product codes of all vectors: each is cut into equal parts, and each part is written as the index of its nearest codebook entry.

    table: vec_id (a number), embedding (array of numbers) and label (any type). Rows whose vector is null or holds null, NaN or
    infinite components are dropped. Codebooks start as the parts of the smallest distinct ids (null ids last; of rows of one id, the
    smallest vector), or of as many as there are, and are moved rounds times to the floors of their parts' means. All arithmetic is
    on whole numbers and exact, ties go to lower indexes, so results depend on neither partitions nor the order of rows.

    Returns vec_id, code (two hex digits a part), error (squared distance, at most 2**63 - 1), label_error (errors of equal labels,
    nulls together, at most 2**63 - 1) and codebooks_sha256. Repeated rows are rows of their own. Vectors can be coded together if
    they have one length: that of the smallest id whose length is a multiple of parts. Others keep their row with code and error null.
    An empty table gives no rows; other columns are ignored. entries is at most 256."""
    small_batches(table.sparkSession)
    vectors = saved(whole_vectors(table, scale), "vectors")
    length = F.size("parts")
    found = vectors.where((length > 0) & (length % parts == 0)).select("vec_id", length.alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    n = found["n"] if found else 0
    able = vectors.where(length == n) if n else vectors.where(F.lit(False))
    books = codebooks(able, parts, entries, rounds) if n else np.zeros((parts, 0, 0), np.int64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in table.schema if f.name in ("vec_id", "label")}
    coded = able.select("vec_id", "label", "parts").mapInArrow(partial(_codes, books=books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    none = vectors.where(length != n).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = saved(coded.unionByName(none), "codes")
    total: Column = F.sum(F.col("error").cast("decimal(38,0)"))
    held = F.when(total.isNotNull(), F.least(total, F.lit(_LONGEST))).cast("long")
    by_label = small(saved(rows.groupBy(F.col("label").alias("__label")).agg(held.alias("label_error")), "label-errors"))
    joined = rows.join(by_label, rows["label"].eqNullSafe(by_label["__label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
