"""Per-key results when a handful of keys hold most of the records.

Heavy keys are found by a frequent-items sketch in one pass: those that would fill a good part of a task of their own.
Their records are picked by a broadcast join with the (bounded) list of heavy keys and spread by a salt taken from the counted
value; the records of all other keys take an ordinary shuffle on the key; both results are united.  Both ways
count within each task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.session import parallelism

#: A key is heavy from this part of a task's even share of all records on, and with this share of all at the latest.
PART_OF_TASK, HEAVY_SHARE = 0.5, 0.01
#: Heavy keys there are at most, and so the size of what is broadcast.
MOST_HEAVY = 50_000
#: Items the sketch tracks at least; its error is below 4 / items of all records.
SKETCH_ITEMS = 4096


@dataclass
class KeyLoad:
    """``result`` has key, n_entries and n_values; ``total`` is the number of records with a key."""

    result: DataFrame
    heavy: list
    total: int


def heavy_share(spark: SparkSession) -> float:
    """Share of all records that makes a key heavy: half of a task's, as there are tasks."""
    return max(min(HEAVY_SHARE, PART_OF_TASK / parallelism(spark)), 2 / MOST_HEAVY)


def heavy_hitters(records: DataFrame, key: str, share: float | None = None) -> tuple[list, int]:
    """Keys that may hold at least ``share`` of the non-null keys, and the exact number of those records.

    The sketch's estimate has a bounded error, so keys down to half of ``share`` count as heavy;
    which of the two ways a key goes changes the load, never the result.
    """
    share = share or heavy_share(records.sparkSession)
    k = int(2 / share)
    row = records.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {k}, {max(SKETCH_ITEMS, 4 * k)})").alias("top"), F.count(F.lit(1)).alias("total")
    ).first()
    return [x["item"] for x in row["top"] or [] if x["count"] >= share * row["total"] / 2], row["total"]


def key_load(records: DataFrame, key: str, value: str, share: float | None = None) -> KeyLoad:
    """Number of records and of distinct non-null values per key, evenly loaded.

    Null keys are left out; the empty string is a key like any other, and repeated records count.
    An empty input gives an empty result with total 0.  Other columns are ignored.
    """
    data = records.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k IS NOT NULL")
    heavy, total = heavy_hitters(data, "k", share)
    counted = [F.count(F.lit(1)).alias("n"), F.max(F.col("v").isNotNull().cast("long")).alias("d")]
    if not heavy:
        light, parts = data, None
    else:
        spark = records.sparkSession
        keys = F.broadcast(spark.createDataFrame([(x,) for x in heavy], f"k {data.schema['k'].dataType.simpleString()}"))
        light = data.join(keys, "k", "left_anti")
        # all records of one value share a salt, so the parts' distinct counts add up
        salts = max(64, 2 * parallelism(spark))
        parts = (
            data.join(keys, "k")
            .withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
            .groupBy("k", "salt", "v").agg(*counted)
            .groupBy("k", "salt").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            .groupBy("k").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        )
    rest = light.groupBy("k", "v").agg(*counted).groupBy("k").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    both = rest if parts is None else rest.unionByName(parts)
    return KeyLoad(both.select(F.col("k").alias(key), F.col("n").alias("n_entries"), F.col("d").alias("n_values")), heavy, total)


def link_source_load(document: DataFrame) -> KeyLoad:
    """Load of each link source in ``document.inlinks``: entries and distinct pages linked.

    Null arrays, null entries and empty entries do not count; all rows count, repeated ones too.
    """
    entries = document.select("id", F.explode("inlinks").alias("link_source")).where("link_source <> ''")
    load = key_load(entries, "link_source", "id")
    load.result = load.result.withColumnRenamed("n_values", "n_pages")
    return load


def dominant_link_sources(document: DataFrame, share: float = 0.05) -> DataFrame:
    """Link sources that make up at least ``share`` of all entries; none if there are no entries."""
    load = link_source_load(document)
    return load.result.where(F.col("n_entries") >= F.lit(share) * F.lit(load.total)).select("link_source")
