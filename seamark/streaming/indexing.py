"""Structured Streaming: an index that takes crawled documents as they come, and late-data windows (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seamark.operators.index import last_wins, upsert
from seamark.session import delete, shared_folder


FIELDS = ("id", "text", "inlinks", "outlinks")


def _rows(spark: SparkSession, path: str, kept: dict[int, int]) -> DataFrame:
    """The stored rows of buckets, each of the version that ``kept`` says."""
    paths = [f"{path}/bucket={b}/version={v}" for b, v in sorted(kept.items())]
    return spark.read.parquet(*paths).select(*FIELDS)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of each bucket that are there."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for x in fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*")) or []:
        p = x.getPath()
        if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
            out.setdefault(int(p.getParent().getName()[7:]), []).append(int(p.getName()[8:]))
    return {b: sorted(v) for b, v in out.items()}


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``stream_upserts`` keeps under ``path``."""
    last = {b: v[-1] for b, v in _versions(spark, path).items()}
    return _rows(spark, path, last) if last else spark.createDataFrame([], "id string, text string, inlinks array<string>, outlinks array<string>")


def stream_upserts(documents: DataFrame, path: str, checkpoint: str, order: str = "fetched_at", buckets: int = 64) -> StreamingQuery:
    """Merge a stream of crawled documents into a Parquet table under ``path``, bucketed by the hash of the id.

    A micro-batch rewrites only the buckets it touches, each as a version with the batch's number, made from the last version before;
    so a batch that is run again gives the same table.  Versions older than the last two of a bucket are deleted.
    """
    spark = documents.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        new = last_wins(batch, "id", order).select(*FIELDS).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        work = [shared_folder(spark), shared_folder(spark)]
        new.write.parquet(work[0])
        new = spark.read.parquet(work[0])
        touched = [r["b"] for r in new.select("b").distinct().collect()]  # at most ``buckets`` rows
        there = _versions(spark, path)
        before = {b: max((v for v in there.get(b, ()) if v < n), default=None) for b in touched}
        kept = {b: v for b, v in before.items() if v is not None}
        merged = new.drop("b")
        if kept:
            merged = upsert(_rows(spark, path, kept), merged).select(*FIELDS)
        merged.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition("b").write.partitionBy("b").parquet(work[1])
        merged = spark.read.schema(new.schema).parquet(work[1])
        for b in touched:
            merged.where(F.col("b") == b).drop("b").write.mode("overwrite").parquet(f"{path}/bucket={b}/version={n}")
            for old in [v for v in there.get(b, ()) if v < n][:-1]:
                delete(spark, f"{path}/bucket={b}/version={old}")
        for folder in work:
            delete(spark, folder)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, by: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and ``by`` with a watermark; a time without a zone is taken as the session's."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", by, "n")
