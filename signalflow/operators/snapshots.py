"""Stored tables with a key, changed by numbered batches: a batch rewrites the buckets it touches, and readers see whole batches only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved

#: What a column becomes from its stored and its new value.
Rule = Callable[[Column, Column], Column]
_BUCKET = "__sf_bucket"


def keep_stored(old: Column, new: Column) -> Column:
    """The stored value stays; for rules of columns that only a key's first batch sets."""
    return old


class KeyedTable:
    """One row for each key, in buckets by a hash of the key, or of bucket_by, some columns of the key.

    folder/data/N has the buckets that batch N wrote, folder/marks/N says for each bucket which batch wrote it last. A mark counts once
    its _SUCCESS file is there, which Spark writes last: until then readers see the batch before, and a batch that runs again
    replaces what it left. A batch whose mark counts, or that comes before one, is not applied again. So there is one writer, with
    growing numbers: a streaming query with its own checkpoint, or runs in order.

    Null keys are keys. Columns may have any type that can be ordered. Choose buckets such that one fits a few tasks: a batch rewrites
    all buckets that it has keys of, and no others.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64, bucket_by: list[str] | None = None):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets
        self.bucket_by = bucket_by or keys
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def _path(self, *parts: object) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _listed(self, *parts: object) -> list[str]:
        path = self._path(*parts)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _delete(self, *parts: object) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self) -> list[int]:
        """Numbers of the batches whose marks count, in order."""
        return sorted(int(n) for n in self._listed("marks") if "_SUCCESS" in self._listed("marks", n))

    def _placed(self, version: int | None) -> dict[int, int]:
        """The batch that wrote each bucket last; as many entries as there are buckets, at most."""
        if version is None:
            return {}
        return dict(self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/marks/{version}").collect())

    def _buckets(self, placed: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/{batch}/{_BUCKET}={b}" for b, batch in placed.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table after that batch, by default after the last one. It stays as it is while other batches are applied."""
        known = self.versions()
        return self._buckets(self._placed(version if version is not None else known[-1] if known else None))

    def before(self, number: int) -> int | None:
        """The last batch whose mark counts that comes before this one, which a batch that runs again has to start from."""
        return max((v for v in self.versions() if v < number), default=None)

    def matching(self, keys: DataFrame, version: int | None) -> DataFrame:
        """Rows of the keys (columns named as the table's) after that batch (None: before the first); only the keys' buckets are read."""
        asked = keys.select(*self.keys).distinct()
        return self.of_buckets(asked, version).join(asked, self.keys, "left_semi")

    def of_buckets(self, keys: DataFrame, version: int | None) -> DataFrame:
        """All rows of the buckets that the keys (columns of bucket_by) are in."""
        placed = self._placed(version)
        touched = {r[0] for r in keys.select(self._bucket().alias(_BUCKET)).distinct().collect()} if placed else set()
        return self._buckets({b: n for b, n in placed.items() if b in touched})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def apply(self, number: int, changes: DataFrame, order: list[str], rules: dict[str, Rule] | None = None) -> None:
        """Put changes (all columns of the table) in as batch number.

        Of a key's changes in one batch the last by order counts (nulls first, ties by the other columns). Where the key is stored, each
        column takes the new value, or what its rule makes of both. order may name columns that the table lacks.
        """
        known = self.versions()
        if known and known[-1] >= number:
            return
        placed = self._placed(known[-1] if known else None)
        sort = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in self.columns if c not in order])
        last = changes.groupBy(*[F.col(k).alias(f"__sf_{k}") for k in self.keys]).agg(F.max(sort).alias("r")).select(*[F.col("r")[c].alias(c) for c in self.columns])
        bucket = self._bucket()
        new = saved(last.withColumn(_BUCKET, bucket), "changes")
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # no more than there are buckets
        old = self._buckets({b: placed[b] for b in touched if b in placed}).withColumn("__sf_stored", F.lit(True))
        same = reduce(lambda x, y: x & y, [old[k].eqNullSafe(new[k]) for k in self.keys])
        both, stored, changed = old.join(new, same, "full_outer"), old["__sf_stored"].isNotNull(), new[_BUCKET].isNotNull()
        ruled = lambda c: (rules or {})[c](old[c], new[c]) if c in (rules or {}) else new[c]
        merged = both.select(*[F.when(stored & changed, ruled(c)).when(changed, new[c]).otherwise(old[c]).alias(c) for c in self.columns])
        # Large buckets are split over tasks, small ones are written by one.
        merged.withColumn(_BUCKET, bucket).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.folder}/data/{number}")
        self._mark(number, placed | {b: number for b in touched})

    def _mark(self, number: int, placed: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(placed.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{number}")

    def forget(self, keep: int = 2) -> None:
        """Delete what the last batches, keep of them, do not need. Readers of older ones must have ended; a batch under way is left alone."""
        known = self.versions()
        gone, kept = known[:-keep], known[-keep:]
        needed = {(batch, b) for v in kept for b, batch in self._placed(v).items()}
        for version in gone:
            self._delete("marks", version)
        for batch in self._listed("data"):
            if known and int(batch) <= known[-1]:
                for name in self._listed("data", batch):
                    if name.startswith(_BUCKET) and (int(batch), int(name.rsplit("=", 1)[1])) not in needed:
                        self._delete("data", batch, name)
