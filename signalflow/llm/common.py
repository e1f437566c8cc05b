"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII control characters 09-0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Largest number of rows, and of bytes in their strings, that are broadcast; above them the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


#: Rows in a batch between the JVM and Python: whole texts are long, and both sides hold a batch or two per task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a task's memory does not depend on how many texts its input has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder in local mode; on a
    cluster, whose machines do not share local folders, it must be set, and RuntimeError says so."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_dir(spark)}/signalflow/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/signalflow/" in f}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if its counted rows are at most limit, and the bytes of its strings at most BROADCAST_BYTES. df
    should be a saved() table: rows are then counted from metadata, and only strings are read."""
    if df.count() > limit:
        return df
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return F.broadcast(df) if not texts or (df.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0) <= BROADCAST_BYTES else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (src, dst: long): one row (id, label) per vertex that has an edge to another one;
    label is the smallest id that is reachable.

    Alternating large-star and small-star rounds: every round points vertices at their smallest known neighbour, rewires
    the neighbours to it, and ends when the edges no longer change. The edge set never grows. Null ends, self-links and
    repeated links are ignored; an empty table gives an empty result. Raises RuntimeError instead of stopping early.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst")
    now = saved(
        clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(total) == before:
            return now.select(F.col("src").alias("id"), F.col("dst").alias("label")).unionAll(
                now.select("dst", F.col("dst")).distinct()
            )
        before = tuple(total)
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        # Large star: each vertex links its larger neighbours to the smallest vertex around it.
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Small star: each vertex links its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small_star = (
            large.join(least, "src")
            .select(F.explode(F.array("src", "dst")).alias("src"), F.col("m").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        after = saved(small_star, "edges")
        discard(now)
        now = after
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
