"""Exact deduplication with a log-structured merge index of text digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, small

#: Entries of a task's memtable, and batches of runs on a level that are merged into one of the next level.
MEMTABLE_ROWS, FANOUT = 200_000, 4


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _memtables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A task's entries (digest, id) as sorted runs: entries of equal digest are combined in a memtable, which is flushed in the
    order of digests when it holds so many rows, and at the end."""
    held: list[pa.RecordBatch] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids = table.column("id")
        table = table.append_column("rows", pa.array(np.ones(len(ids), np.int64))).append_column("largest", ids)
        table = table.group_by("digest").aggregate([("rows", "sum"), ("id", "min"), ("largest", "max")]).sort_by("digest")
        yield from table.select(["digest", "rows_sum", "id_min", "largest_max"]).rename_columns(["digest", "rows", "smallest", "largest"]).to_batches(max_chunksize=10_000)
        held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from flushed()
    if held:
        yield from flushed()


class DigestIndex:
    """A log-structured merge index: digest -> number of rows, smallest and largest identifier.

    flush() adds a batch: in each task a memtable of at most MEMTABLE_ROWS entries combines equal digests and is written as a
    sorted run whenever it is full. compact() merges level by level: as soon as a level has FANOUT batches of runs, they become
    one of the next level, which keeps the extreme identifiers and adds up the counts; so an entry is rewritten about as
    often as there are levels. entries() merges what is left when it is asked for. A merge is written under a name of its own
    and counts only once it is written, and only then are the runs that it replaces no longer read; so losing an
    executor, or the writer, loses nothing. A batch that is flushed again under its name replaces the first. Files
    carry Parquet's Bloom filters on the digest, for readers that look up single digests.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        """The folders that make up the index, of all levels."""
        return [r for level in self.levels for r in level]

    def _write(self, entries: DataFrame, path: str) -> str:
        (
            entries.write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "digest binary, rows long, smallest long, largest long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("digest").agg(F.sum("rows").alias("rows"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))

    def flush(self, entries: DataFrame, run: str) -> None:
        """Add a batch (digest, id) as the sorted runs of that name. Null ids count as rows but not as identifiers."""
        small = entries.select("digest", F.col("id").cast("long").alias("id"))
        runs = small.mapInArrow(partial(_memtables, rows=MEMTABLE_ROWS), "digest binary, rows long, smallest long, largest long")
        path = self._write(runs, f"{self.path}/level0/{run}")
        if path not in self.levels[0]:
            self.levels[0].append(path)

    def compact(self) -> None:
        """Merge each level that has FANOUT batches of runs into one of the next level."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FANOUT:
                merged = self._merged(self._read(self.levels[level])).repartitionByRange("digest").sortWithinPartitions("digest")
                path = self._write(merged, f"{self.path}/level{level + 1}/{uuid.uuid4().hex}")
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(path)
                self.levels[level] = []
            level += 1

    def entries(self) -> DataFrame:
        """One row for each digest, over all runs."""
        return self._merged(self._read(self.runs))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The index entries of the given digests (one column, digest), over all runs; absent digests give no row."""
        return self._merged(self._read(self.runs).join(digests.distinct(), "digest", "left_semi"))


def exact_groups(documents: DataFrame, keep: str = "largest", index: DigestIndex | None = None) -> DataFrame:
    """Groups of documents with identical texts.

    Digests of all rows go through a DigestIndex; rows whose digest occurs once are alone. Hits are verified
    by their bytes: rows of a digest are grouped by the text itself, so that unequal texts of one digest would still
    end up in groups of their own. That grouping combines copies before the shuffle, so a group of any size moves
    about one text per task. With an index that holds earlier batches, their rows count as well.

    documents: doc_id (integer), text. Null text counts as empty. keep: "largest" or "smallest" doc_id stays. Returns per
    row doc_id, keep_id, group_size, kept and text_sha256 (hex). A row with a null doc_id counts in group_size
    and is kept only in a group where every id is null. Rows that repeat the kept doc_id are all kept. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    index = index or DigestIndex(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = saved(documents.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    index.flush(slim.select("digest", F.col("doc_id").alias("id")), "batch-" + uuid.uuid4().hex)
    index.compact()
    entries = saved(index.entries(), "digest-entries")
    hits = saved(entries.where("rows > 1").select("digest"), "digest-hits")
    suspects = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_digest(F.col("text")).alias("digest"))
    # One row for each digest and distinct text behind it; bytes decide, not digests.
    verified = saved(
        suspects.join(small(hits), "digest", "left_semi")
        .groupBy("digest", "text")
        .agg(F.count("*").alias("rows"), F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"))
        .select("digest", "rows", "smallest", "largest", F.xxhash64("text").alias("variant")),
        "digest-verified",
    )
    clashes = verified.groupBy("digest").count().where("count > 1").select("digest")
    keeper = F.col(keep)
    if clashes.isEmpty():
        groups = entries.select("digest", F.col("rows").alias("group_size"), keeper.alias("keep_id"))
        out = slim.join(groups, "digest")
    else:  # different texts behind one digest: the text's own hash tells them apart
        apart = verified.join(clashes, "digest", "left_semi").select("digest", "variant", F.col("rows").alias("group_size"), keeper.alias("keep_id"))
        whole = entries.join(clashes, "digest", "left_anti").select("digest", F.col("rows").alias("group_size"), keeper.alias("keep_id"))
        split = suspects.withColumn("variant", F.xxhash64("text")).join(apart, ["digest", "variant"]).drop("variant", "text")
        out = slim.join(whole, "digest").unionByName(split)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(documents: DataFrame, keep: str = "largest") -> DataFrame:
    """documents without the rows that exact_groups() drops; columns as before. Of rows that agree in id and text
    all stay, since nothing tells them apart."""
    groups = exact_groups(documents, keep).where("not kept").select("doc_id", F.unhex("text_sha256").alias("__sf_digest"))
    gone = small(saved(groups.withColumnRenamed("doc_id", "__sf_id").distinct(), "copies"))
    same = (text_digest(documents["text"]) == gone["__sf_digest"]) & documents["doc_id"].eqNullSafe(gone["__sf_id"])
    return documents.join(gone, same, "left_anti")
