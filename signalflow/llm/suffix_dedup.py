"""Passages that repeat across documents, by a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, small, small_batches
from .shingles import _word_powers, chunks, mix64, ngram_hashes, word_hashes

#: Passages of at least this many words are found. A power of two of key positions competes for each suffix that is kept.
MIN_WORDS, WINDOW = 50, 32


def _runs(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring passages that select the same position: (gram index of the position, first passage, passages).

    A passage starting at gram i covers grams i .. i + WINDOW - 1 and selects the smallest of them, the leftmost of equals;
    so equal passages select the same place in any text."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low, chosen = grams, np.arange(len(grams))
    step = 1
    while step < WINDOW:
        right = low[step:] < low[:-step]
        low, chosen = np.where(right, low[step:], low[:-step]), np.where(right, chosen[step:], chosen[:-step])
        step *= 2
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.arange(n) + WINDOW <= first[text + 1]
    begins = np.flatnonzero(inside & np.concatenate(([True], (chosen[1:] != chosen[:-1]) | ~inside[:-1] | (text[1:] != text[:-1]))))
    breaks = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1]), [True])))
    length = np.diff(breaks)[np.searchsorted(breaks, begins)]
    return chosen[begins], begins, length


def _span_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _word_powers.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The kept suffixes of each text: key (hash of the words at the selected position), around (hash of all words of the
    passages that select it), lo (first word of the first such passage) and n (how many passages)."""
    key_words = min_words - WINDOW + 1
    for batch in batches:
        ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for at, texts in chunks(batch.column(2).cast(pa.binary()).to_pylist()):
            words = word_hashes(texts)
            grams, first = ngram_hashes(words, key_words)
            chosen, begin, count = _runs(grams, first)
            if not len(chosen):
                continue
            text = np.searchsorted(first, begin, side="right") - 1
            lo = begin - first[text]
            word = words.first[text] + lo
            around = _span_hashes(words.hashes, word, word + count - 1 + min_words)
            columns = (grams[chosen].view(np.int64), around, ids[at + text], rows[at + text], lo.astype(np.int32), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "around", "doc_id", "row_hash", "lo", "n"])


def _passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the single passages of given runs of a text."""
    for batch in batches:
        runs = batch.column("runs").to_pylist()
        for at, texts in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
            words = word_hashes(texts)
            grams, first = ngram_hashes(words, min_words)
            grams = grams.view(np.int64)
            key, around, low, high, k, passage = [], [], [], [], [], []
            for i in range(len(texts)):
                for r in runs[at + i]:
                    n, lo = r["n"], r["lo"]
                    key.append(np.full(n, r["key"]))
                    around.append(np.full(n, r["around"]))
                    low.append(np.full(n, r["low_doc"]))
                    high.append(np.full(n, r["high_doc"]))
                    k.append(np.arange(n, dtype=np.int32))
                    passage.append(grams[first[i] + lo : first[i] + lo + n])
            if key:
                columns = [pa.array(np.concatenate(c)) for c in (key, around, low, high, k, passage)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "around", "low_doc", "high_doc", "k", "passage"])


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal stretches of words all of whose passages of min_words words also occur in another document.

    Suffixes are kept only where content selects them (the smallest of WINDOW neighbouring keys), so a passage of min_words
    words always keeps one, at the same place wherever it occurs. Shuffling the kept suffixes by key brings neighbours of
    the suffix array together; keys that two documents share remain. Matches are then extended to both sides: where all
    words around two suffixes agree, by one hash; else passage by passage around one representative of each distinct
    surrounding, however many documents share it. Adjoining passages become one stretch.

    documents: doc_id (integer), text. Words are separated by space and 09-0D and compared as they are. Returns doc_id,
    start_word, end_word (exclusive), n_words and first_doc (smallest doc_id that the passage at start_word occurs in). Null,
    empty and shorter texts give nothing, neither do rows with a null doc_id, or repeats inside one document or between rows of
    one doc_id; different texts of one doc_id have stretches of their own, rows that agree in both have theirs once. An empty table gives no rows. Whole texts are read; other columns are ignored. Words are compared by
    64-bit hashes.
    """
    if min_words < WINDOW:
        raise ValueError(f"min_words must be at least {WINDOW}")
    small_batches(documents.sparkSession)
    source = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    suffixes = saved(source.mapInArrow(partial(_suffixes, min_words=min_words), "key long, around long, doc_id long, row_hash long, lo int, n int"), "suffixes")
    met = suffixes.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    shared = saved(suffixes.join(small(saved(met, "shared-keys")), "key"), "shared-suffixes")
    discard(suffixes)
    kinds = saved(
        shared.groupBy("key", "around").agg(
            F.min(F.struct("doc_id", "row_hash", "lo")).alias("first"), F.max("doc_id").alias("high_doc"), F.first("n").alias("n")
        ),
        "surroundings",
    )
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    # One document for each distinct surrounding; a document's runs come to it as a list.
    runs = (
        kinds.join(several, "key", "left_semi")
        .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.row_hash").alias("row_hash"))
        .agg(F.collect_list(F.struct("key", "around", F.col("first.doc_id").alias("low_doc"), "high_doc", F.col("first.lo").alias("lo"), "n")).alias("runs"))
    )
    runs = saved(runs, "runs")
    texts = source.join(small(runs.select("doc_id", "row_hash")), ["doc_id", "row_hash"], "left_semi").dropDuplicates(["doc_id", "row_hash"])
    passages = texts.join(runs, ["doc_id", "row_hash"]).select("text", "runs").mapInArrow(
        partial(_passages, min_words=min_words), "key long, around long, low_doc long, high_doc long, k int, passage long"
    )
    passages = saved(passages, "passages")
    common = passages.groupBy("key", "passage").agg(F.min("low_doc").alias("a"), F.max("high_doc").alias("b"))
    parts = passages.join(common, ["key", "passage"]).where("a <> b").select("key", "around", "k", F.col("a").alias("first_doc"))
    island = Window.partitionBy("key", "around").orderBy("k")
    stretches = (
        parts.select("*", (F.col("k") - F.row_number().over(island)).alias("g"))
        .groupBy("key", "around", "g")
        .agg(F.min("k").alias("k"), F.count("*").cast("int").alias("m"), F.min_by("first_doc", "k").alias("first_doc"))
        .select("key", "around", "k", "m", "first_doc")
    )
    alone = kinds.where("first.doc_id <> high_doc").join(several, "key", "left_anti").select(
        "key", "around", F.lit(0).alias("k"), F.col("n").alias("m"), F.col("first.doc_id").alias("first_doc")
    )
    found = saved(stretches.unionByName(alone), "stretches")
    spans = shared.join(found, ["key", "around"]).select(
        "doc_id", "row_hash", (F.col("lo") + F.col("k")).alias("a"), (F.col("lo") + F.col("k") + F.col("m")).alias("b"), "first_doc"
    )
    before = Window.partitionBy("doc_id", "row_hash").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("a") <= F.max("b").over(before), 0).otherwise(1)
    through = Window.partitionBy("doc_id", "row_hash").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.select("*", opens.alias("new")).select("*", F.sum("new").over(through).alias("span"))
    whole = merged.groupBy("doc_id", "row_hash", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("first_doc", F.col("a")).alias("first_doc"))
    return whole.select(
        "doc_id",
        F.col("a").cast("int").alias("start_word"),
        (F.col("b") - 1 + min_words).cast("int").alias("end_word"),
        (F.col("b") - 1 + min_words - F.col("a")).cast("int").alias("n_words"),
        "first_doc",
    )
