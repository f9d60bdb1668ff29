"""Top N items of every group, with bounds from the partitions.

Each block of a partition computes, for every group of which it holds N distinct items, its own N-th
best (score, item).  Any such pair bounds the group's N-th best from below, so the best bound per group
is joined back and rows below it are dropped before anything is shuffled by group.  The bounds are computed in one
pass and kept.  Those of the groups with most rows are broadcast, as many as MAX_BOUNDS; the others,
each from a few blocks only, are joined by a shuffle.  The survivors are reduced to one row per item and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.session import cut_lineage

#: Rows of one block; a bound needs N items of a group within a block.
BLOCK_ROWS = 500_000
#: Bounds that are broadcast (about 100 bytes each).
MAX_BOUNDS = 500_000


def _block_bounds(n: int):
    """Function for mapInArrow over columns g, s, i (score not NaN, nothing null)."""

    def bounds(table: pa.Table) -> pa.RecordBatch:
        frame = table.to_pandas()
        size = frame.groupby("g", sort=False)["g"].transform("size")
        frame = frame[size >= n].sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable")
        frame = frame.drop_duplicates(["g", "i"])
        nth = frame[frame.groupby("g", sort=False).cumcount() == n - 1]
        return pa.RecordBatch.from_pandas(nth[["g", "s", "i"]], schema=table.schema, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield bounds(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield bounds(pa.Table.from_batches(held))

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """The ``n`` best items of each group: group, item, score, rank from 1.

    Items rank by score descending, then by item ascending in byte order.  Rows with a null group, item
    or score or a NaN score do not count; of several rows of one item the highest score counts; groups
    with fewer items give all they have; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{item}`").alias("i"))
    rows = rows.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)").withColumn("s", F.col("s") + F.lit(0.0))
    found = rows.mapInArrow(_block_bounds(n), rows.schema)
    # the best bound of a group is the highest score, then the smallest item
    best = found.groupBy("g").agg(F.min(F.struct((-F.col("s")).alias("s"), "i")).alias("b"), F.count(F.lit(1)).alias("blocks"))
    best = cut_lineage(best.select("g", (-F.col("b.s")).alias("bs"), F.col("b.i").alias("bi"), "blocks"))
    within = F.expr("bs IS NULL OR s > bs OR (s = bs AND i <= bi)")
    many = best.count() > MAX_BOUNDS
    first = best.orderBy(F.desc("blocks"), "g").limit(MAX_BOUNDS) if many else best
    kept = rows.join(F.broadcast(first.drop("blocks")), "g", "left").where(within)
    if many:
        others = best.join(F.broadcast(first.select("g")), "g", "left_anti").drop("blocks")
        kept = kept.drop("bs", "bi").join(others, "g", "left").where(within)
    each = kept.groupBy("g", "i").agg(F.max("s").alias("s"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("s"), F.asc("i")))
    return each.withColumn("rank", rank).where(F.col("rank") <= n).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank"
    )
