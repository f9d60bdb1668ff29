"""Inverted index: postings, term statistics, lengths, the stored index, and the upsert of crawled documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.functions.text import LATIN, term_counts, tokens
from seamark.operators.topk import pack, unpack


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", stop: list[str] | None = None, stem: bool = False, stop_first: bool = False) -> DataFrame:
    """(doc_id, term, tf).  The analyzer stems, then drops stop words; ``stop_first`` turns that round."""
    words = docs.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("words"))
    if not stem:
        rows = words.select("doc_id", F.explode("words").alias("term"))
        rows = rows.where(~F.col("term").isin(*stop)) if stop else rows
        return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # a key may have several rows
    return term_counts(words, stop, stem, stop_first).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


@dataclass
class Index:
    """A stored index: ``shards``, the packed postings (see ``topk.pack``), ``terms`` (term, df, ttf) and ``stats``, one row (n_docs, total_len, avg_len)."""

    shards: DataFrame
    terms: DataFrame
    stats: DataFrame
    stop: tuple[str, ...] = ()
    stem: bool = False

    @property
    def posts(self) -> DataFrame:
        """(doc_id, len, term, tf)."""
        return unpack(self.shards)


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = (), stem: bool = True) -> Index:
    """Write the index of documents with unique keys to ``path`` and open it.

    Documents are counted and packed where they lie; only their terms' counts are shuffled.
    """
    spark = docs.sparkSession
    # few texts have a character that only the JVM parts tokens at
    words = docs.select(F.col(key).alias("doc_id"), F.when(~F.col(text).rlike(LATIN), tokens(F.col(text))).alias("words"), F.col(text).alias("text"))
    # row groups of some 100 MB at most
    pack(words, list(stop), stem).write.option("parquet.block.row.count.limit", 16).parquet(f"{path}/shards")
    counts = spark.read.parquet(f"{path}/shards").select(F.explode(F.arrays_zip("terms", "df", "ttf")).alias("x"))
    counts.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"), F.sum("x.ttf").alias("ttf")).write.parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("ttf"), F.lit(0)).alias("total_len"))
    n = docs.select(F.count(F.lit(1)).alias("n_docs"))
    stats = n.crossJoin(total).withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")))  # one row each
    stats.withColumns({"stop": F.array(*[F.lit(w) for w in stop]).cast("array<string>"), "stem": F.lit(stem)}).coalesce(1).write.parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index stored at ``path``."""
    stats = spark.read.parquet(f"{path}/stats")
    how = stats.first()
    return Index(spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/terms"), stats.select("n_docs", "total_len", "avg_len"), tuple(how["stop"]), how["stem"])


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, ttf): documents that hold a term, and its occurrences; no cap on either."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len) of all documents; 0 without a text."""
    return docs.select(F.col(key).alias("doc_id"), F.size(tokens(F.col(text))).cast("bigint").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len; empty documents count."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.avg("len").alias("avg_len"))


def term_vector(posts: DataFrame, doc_id) -> DataFrame:
    """Terms of one document with their frequencies."""
    return posts.where(F.col("doc_id") == doc_id).select("term", "tf")


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last in the given order (nulls first); rows without a key are dropped."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("b")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[f"b.{c}" for c in (*order, *rest)])


def upsert(old: DataFrame, new: DataFrame, keep_if_empty: bool = False) -> DataFrame:
    """Merge crawled documents (id, text, inlinks, outlinks), one row per id on either side: (..., action).

    New ids are inserted.  Known ids get the union of their inlinks; where that adds any, text and outlinks are
    taken from the new row (update), else the old row stays (keep).  With ``keep_if_empty`` a known document
    without inlinks is left alone.
    """
    links = lambda c: F.coalesce(F.array_compact(c), F.array().cast("array<string>"))
    o, n = (d.select("id", F.lit(True).alias("here"), "text", links("inlinks").alias("inlinks"), links("outlinks").alias("outlinks")) for d in (old, new))
    both = o.alias("o").join(n.alias("n"), "id", "full")
    union = F.array_union("o.inlinks", "n.inlinks")
    grown = F.size(union) > F.size(F.array_distinct("o.inlinks"))
    if keep_if_empty:
        grown = grown & (F.size("o.inlinks") > 0)
    action = F.when(F.col("o.here").isNull(), "insert").when(F.col("n.here").isNull(), "keep").when(grown, "update").otherwise("keep")
    fresh = action != "keep"
    return both.select(
        "id", F.when(fresh, F.col("n.text")).otherwise(F.col("o.text")).alias("text"),
        F.when(action == "insert", F.col("n.inlinks")).when(fresh, union).otherwise(F.col("o.inlinks")).alias("inlinks"),
        F.when(fresh, F.col("n.outlinks")).otherwise(F.col("o.outlinks")).alias("outlinks"), action.alias("action"),
    )
