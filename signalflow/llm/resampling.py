"""Importance resampling towards a target's texts: hashed n-grams, gains by bucket, and a Gumbel draw without replacement.

Hashes are CRC-32, computed for all n-grams of a batch at once by position tables instead of byte after byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that a position table covers; longer spans are folded in blocks of so many.
REACH = 64
#: Bytes of texts, and bytes of spans, that are worked on at once.
TEXT_BYTES, SPAN_BYTES = 4_000_000, 1 << 20
#: Bars of the histogram of scores that the boundary of a draw is looked up in, and rows of a task that ranks.
SCORE_BARS, RANK_ROWS = 4096, 2_000_000


class PositionCrc:
    """CRC-32 of many byte spans at once.

    CRC-32 is linear over exclusive or: a span's register is the XOR of what each byte gives by its distance from the span's end
    (`table[distance, byte]`), and a constant of the length, which the register's first value leaves. So all spans are one gather
    and one `bitwise_xor.reduceat`. Spans over `reach` bytes (at least 4) are cut into blocks from their end; the register after a
    block enters the first four bytes of the next one."""

    def __init__(self, reach: int = REACH) -> None:
        self.reach = reach
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
        self.table = np.empty((reach, 256), np.uint32)
        self.table[0] = step
        for d in range(1, reach):
            self.table[d] = (self.table[d - 1] >> 8) ^ step[self.table[d - 1] & 255]
        state = [0xFFFFFFFF]
        for _ in range(reach):
            state.append((state[-1] >> 8) ^ int(step[state[-1] & 255]))
        self.started = np.array(state, np.uint32)

    def _registers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What the bytes of spans of 1 to reach bytes leave in a register that begins with 0."""
        out = np.empty(len(starts), np.uint32)
        ends = np.cumsum(lengths)
        cuts = np.searchsorted(ends, np.arange(SPAN_BYTES, (ends[-1] if len(ends) else 0) + SPAN_BYTES, SPAN_BYTES), "right")
        low = 0
        for high in np.unique(np.append(np.maximum(cuts, 1), len(starts))) if len(starts) else ():
            n = lengths[low:high]
            last = np.cumsum(n)
            first = last - n
            ahead = np.repeat(last, n) - np.arange(last[-1])
            out[low:high] = np.bitwise_xor.reduceat(self.table[ahead - 1, data[np.repeat(starts[low:high] + n, n) - ahead]], first)
            low = high
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of data[starts[i] : starts[i] + lengths[i]] for every i; data is uint8."""
        out = np.zeros(len(starts), np.uint32)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.reach))
        out[short] = ~(self._registers(data, starts[short], lengths[short]) ^ self.started[lengths[short]])
        left = np.flatnonzero(lengths > self.reach)
        if len(left):
            at, head = starts[left].copy(), (lengths[left] - 1) % self.reach + 1
            state = self._registers(data, at, head) ^ self.started[head]
            at += head
            todo = np.arange(len(left))
            stop = starts[left] + lengths[left]
            while len(todo := todo[at[todo] < stop[todo]]):
                block = self._registers(data, at[todo], np.full(len(todo), self.reach))
                for k in range(4):
                    block ^= self.table[self.reach - 1 - k, (state[todo] >> np.uint32(8 * k)) & np.uint32(255)]
                state[todo] = block
                at[todo] += self.reach
            out[left] = ~state
        return out


@lru_cache(maxsize=1)
def _crc() -> PositionCrc:
    return PositionCrc()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of other characters than ASCII.
_OF_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def _word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and the text each stands in; text i is data[borders[i] : borders[i + 1]]."""
    inside = _OF_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = borders[:-1][borders[:-1] < borders[1:]]
    first[heads] = inside[heads]
    tails = borders[1:][borders[:-1] < borders[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(borders, starts, "right") - 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (from, to) of texts of about TEXT_BYTES, with their lower-cased bytes and borders; a single text is never cut."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + TEXT_BYTES, "right")) - 1)
        yield low, high, _LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        low = high


def hashed_features(texts: pa.Array, n: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (from, to) of texts with their words by text, and the text and bucket of each run of 1 to n consecutive words."""
    for low, high, data, borders in _slices(texts):
        starts, lengths, of = _word_spans(data, borders)
        words = np.bincount(of, minlength=high - low)
        if n > 1 and len(starts):  # words with one space between them, so that every run of words is one span
            placed = np.cumsum(lengths + 1) - lengths - 1
            joined = np.full(placed[-1] + lengths[-1] + 1, 32, np.uint8)
            step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            joined[np.repeat(placed, lengths) + step] = data[np.repeat(starts, lengths) + step]
            data, starts = joined, placed
        texts_of, found = [], []
        for k in range(1, n + 1):
            whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1]) if len(of) >= k else np.zeros(0, np.int64)
            end = starts[whole + k - 1] + lengths[whole + k - 1]
            texts_of.append(of[whole])
            found.append(_crc().of(data, starts[whole], end - starts[whole]).astype(np.int64) % buckets)
        yield low, high, words, np.concatenate(texts_of), np.concatenate(found)


def _counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for *_, found in hashed_features(batch.column(0), n, buckets):
            total += np.bincount(found, minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the column text: a count per task and bucket is shuffled, one number a bucket collected."""
    counted = texts.select(F.col("text").cast("string")).mapInArrow(partial(_counts, n=n, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, count in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = count
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, both with 1 added to each bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: float((a + 1) * (s + n)) / float((b + 1) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(target, source, strict=True)], np.int64)


def _weights(batches: Iterator[pa.RecordBatch], n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_features", "weight"]
    for batch in batches:
        for low, high, words, of, found in hashed_features(batch.column(1), n, len(gains)):
            weight = np.zeros(high - low, np.int64)
            np.add.at(weight, of, gains[found])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(words), pa.array(np.bincount(of, minlength=high - low)), pa.array(weight)], names)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A document's fixed noise: floor(1000 times a Gumbel variate) from the first 8 hex digits of sha256("seed:doc_id"); a null id
    is written as nothing."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """The draw rows of the highest score, ties to the smaller doc_id and null ids last, with their rank from 1; scored is a saved
    table. All other rows have rank null.

    A histogram of scores tells from which bar on rows can be drawn. These rows alone are dealt out by ranges of score, id and row,
    so that a score or an id that many rows share is split, and each range counts on from the rows before it."""
    low, high = scored.where("eligible").agg(F.min("score"), F.max("score")).first()
    none = scored.select("*", F.lit(None).cast("long").alias("rank"))
    if draw <= 0 or low is None:
        return none
    width = (high - low) // SCORE_BARS + 1
    bar = F.floor((F.col("score") - low) / width).cast("long")
    bars = dict(scored.where("eligible").groupBy(bar.alias("bar")).count().collect())
    left, edge = draw, 0
    for edge in sorted(bars, reverse=True):
        left -= bars[edge]
        if left <= 0:
            break
    near = F.col("eligible") & (bar >= edge)
    rows = sum(n for b, n in bars.items() if b >= edge)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    ranges = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANK_ROWS + 1)
    dealt = saved(
        scored.where(near).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()),
        "ranges",
    )
    before, offsets = 0, []
    for number, count in sorted(dealt.groupBy("__range").count().collect()):
        offsets.append((number, before))
        before += count
    known = F.broadcast(scored.sparkSession.createDataFrame(offsets, "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    drawn = dealt.join(known, "__range").withColumn("rank", place.cast("long"))
    kept = drawn.select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return kept.unionByName(none.where(~F.coalesce(near, F.lit(False))))


def resampled(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Draw percent % (rounded down) of the documents with min_words words or more, likelier the more their n-grams look like the
    target's: each document's weight is the sum of its n-grams' gains, and the highest sums of weight and Gumbel noise are drawn,
    which is a draw without replacement in proportion to exp(weight / 1000).

    documents: doc_id of any type and text; target: text. Words are runs of ASCII letters (A-Z lower-cased) and digits and of
    all other characters than ASCII; whole texts are read. Returns doc_id, n_words, n_features, weight, score, eligible and rank
    (from 1 in the order of score, ties to the smaller id; null if not drawn). Null and empty texts have no features and weight 0;
    null ids come last among ties, and their noise is that of an empty id; repeated rows are rows of their own with equal scores.
    Empty tables count as no n-grams. Other columns are ignored."""
    small_batches(documents.sparkSession)
    gains = bucket_gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets))
    kind = documents.schema["doc_id"].dataType.simpleString()
    weighed = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_weights, n=n, gains=gains), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = saved(
        weighed.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("eligible")), "scores"
    )
    return ranked(scored, percent * scored.where("eligible").count() // 100)


def drawn_documents(documents: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The documents that are drawn, with the columns of documents: resampled()'s rows whose id was drawn. Ids must be unique and not
    null for that; rows of a repeated id come together if one of them is drawn."""
    ids = resampled(documents.select("doc_id", "text"), target, **options).where("rank is not null").select("doc_id").distinct()
    return documents.join(ids, "doc_id", "left_semi")
