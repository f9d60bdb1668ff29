"""References to records that do not exist.

Keys are range-partitioned on their 64-bit hash, whose ranges are even whatever the keys look like.
Per range the parents form a sorted array; batches of references stream past it and are probed by
vectorised binary search, the key text deciding where hashes meet.  There are as many ranges as parents and
references need, and several of them to a task, so tasks are even.  Ranges that receive more
references than that are cut by a salt, and their parents (bounded per range) repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from seamark.functions.urls import has_path, link_target
from seamark.session import cut_lineage, parallelism, store

#: Parents of one range, on average; bounds the sorted array a task holds.
PARENTS_PER_RANGE = 100_000
#: References of one range, and ranges of one task, on average.
REFS_PER_RANGE, RANGES_PER_TASK = 100_000, 4
#: Ranges there are at most; beyond it they grow.  The list of hot ranges that is broadcast is no longer than this (12 bytes each).
MOST_RANGES = 1 << 20


def _probe(carried: list[str]):
    """Function for mapInArrow over partitions sorted by (range, salt, kind, hash): parents come before references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, texts = None, [], []
        sorted_keys = sorted_texts = None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in ("rng", "salt", "kind")])
            edges = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                here = (place[0, lo], place[1, lo])
                if here != at:
                    at, keys, texts, sorted_keys = here, [], [], None
                if place[2, lo] == 0:
                    keys.append(np.asarray(part.column("h")))
                    texts.append(part.column("key"))
                    continue
                if sorted_keys is None:
                    sorted_keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
                    sorted_texts = pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string())
                    if isinstance(sorted_texts, pa.ChunkedArray):
                        sorted_texts = sorted_texts.combine_chunks()
                lost = _missing(sorted_keys, sorted_texts, np.asarray(part.column("h")), part.column("key"))
                if lost.any():
                    yield part.filter(pa.array(lost)).select(carried)

    return run


def _missing(keys: np.ndarray, texts: pa.Array, wanted: np.ndarray, names: pa.Array) -> np.ndarray:
    """Which of the wanted keys are not among the sorted parents."""
    lost = np.ones(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    while True:
        maybe = np.flatnonzero(lost & (at < len(keys)))
        maybe = maybe[keys[at[maybe]] == wanted[maybe]]
        if not len(maybe):
            return lost
        same = pc.equal(texts.take(pa.array(at[maybe])), names.take(pa.array(maybe)))
        lost[maybe[same.to_numpy(zero_copy_only=False)]] = False
        at = at + 1  # another parent with the same hash, if there is one


def missing_references(refs: DataFrame, key: str, parents: DataFrame, parent_key: str, spread: str) -> DataFrame:
    """Rows of ``refs`` whose ``key`` is no ``parent_key``; null keys refer to nothing and are left out.

    ``spread`` names a column that parts the references of one key evenly.  Repeated rows stay,
    repeated and null parents do no harm, and columns of any name pass through.
    """
    spark = refs.sparkSession
    fields = [f"c{i}" for i in range(len(refs.columns))]
    body = refs.select(F.struct(*[F.col(f"`{c}`").alias(x) for c, x in zip(refs.columns, fields)]).alias("body"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{spread}`")).alias("sp"))
    body = store(body.where("key IS NOT NULL").withColumn("h", F.xxhash64("key")))  # made once, counted and then probed
    known = store(parents.select(F.col(parent_key).alias("key")).where("key IS NOT NULL").distinct().withColumn("h", F.xxhash64("key")))
    n_known, n_refs = known.count(), body.count()
    wanted = max(2, n_known / PARENTS_PER_RANGE, n_refs / REFS_PER_RANGE, RANGES_PER_TASK * parallelism(spark))
    bits = math.ceil(math.log2(min(wanted, MOST_RANGES)))
    rng = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 64 - bits).cast("int")
    body, known = body.withColumn("rng", rng), known.withColumn("rng", rng)
    # a range is hot with twice its share; the hot ones hold that many references each, so there are less than half of all ranges
    fair = max(1.0, n_refs / 2**bits)
    hot = cut_lineage(body.groupBy("rng").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * fair).select("rng", F.ceil(F.col("n") / fair).cast("int").alias("salts")))
    salts, parts = F.broadcast(hot), (1 << bits) + (hot.agg(F.coalesce(F.sum("salts"), F.lit(0))).first()[0])
    probes = body.join(salts, "rng", "left").withColumn("salt", F.pmod("sp", F.coalesce("salts", F.lit(1))).cast("int"))
    arrays = known.join(salts, "rng", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    nothing = F.lit(None).cast(body.schema["body"].dataType)
    both = arrays.select("rng", "salt", F.lit(0).alias("kind"), "h", "key", nothing.alias("body")).unionByName(
        probes.select("rng", "salt", F.lit(1).alias("kind"), "h", "key", "body")
    )
    placed = both.repartition(max(parallelism(spark), parts // RANGES_PER_TASK), "rng", "salt").sortWithinPartitions("rng", "salt", "kind", "h")
    found = placed.mapInArrow(_probe(["body"]), T.StructType([T.StructField("body", body.schema["body"].dataType)]))
    return found.select(*[F.col(f"body.{x}").alias(c) for c, x in zip(refs.columns, fields)])


def existing_pages(document: DataFrame, crawl_seed: DataFrame) -> DataFrame:
    """Urls that exist: seeds, and ids whose newest row (null time is oldest) is not 404 or 410.

    Of several newest rows one living row is enough; a null status is not a deletion.
    """
    alive = F.coalesce(~F.col("http_status").isin(404, 410), F.lit(True))
    newest = document.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("fetched_at", alive.alias("alive"))).alias("last"))
    return newest.where("last.alive").select(F.col("id").alias("url")).unionByName(crawl_seed.select("url"))


def references(document: DataFrame) -> DataFrame:
    """Entries of both link arrays with their canonical target and the month of the fetch.

    Null and empty entries and targets without a ``/`` after the host are no references.
    """
    period = F.coalesce(F.date_format("fetched_at", "yyyy-MM"), F.lit("unknown"))
    links = document.select("id", period.alias("ref_period"), F.explode(F.array(
        F.struct(F.lit("outlinks").alias("f"), F.col("outlinks").alias("a")), F.struct(F.lit("inlinks").alias("f"), F.col("inlinks").alias("a"))
    )).alias("x"))
    links = links.select("id", F.col("x.f").alias("link_field"), F.explode(F.array_distinct("x.a")).alias("link_target"), "ref_period")
    return links.where("link_target <> ''").withColumn("target", link_target(F.col("link_target"))).where(has_path(F.col("target")))


def orphan_references(document: DataFrame, crawl_seed: DataFrame) -> DataFrame:
    """Distinct (id, link_field, link_target, ref_period) whose target page does not exist."""
    lost = missing_references(references(document), "target", existing_pages(document, crawl_seed), "url", "id")
    return lost.select("id", "link_field", "link_target", "ref_period").distinct()


def orphan_report(document: DataFrame, crawl_seed: DataFrame) -> DataFrame:
    """Orphan references per link field and month: references, pages that hold them, distinct targets."""
    return orphan_references(document, crawl_seed).groupBy("link_field", "ref_period").agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("id").alias("n_pages"), F.countDistinct("link_target").alias("n_targets")
    )
