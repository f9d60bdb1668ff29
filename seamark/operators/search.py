"""Ranked retrieval over the inverted index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.functions.text import REFINE_STEMS, refined_tokens, term_counts
from seamark.operators.index import Index
from seamark.operators.topk import Weight, first_documents, unpack

K1, K2, B = 1.2, 100.0, 0.75


def analyzed_queries(queries: DataFrame, stop: list[str] | None = None, stem: bool = True) -> DataFrame:
    """(query_id, term, qtf) of the refined query texts, stemmed and without stop words; null texts and queries without terms give nothing."""
    words = queries.where("query_id IS NOT NULL").select(F.col("query_id").alias("doc_id"), refined_tokens(F.col("text")).alias("words"))
    terms = term_counts(words, stop, stem).where(~F.col("term").isin(*REFINE_STEMS))
    return terms.groupBy(F.col("doc_id").alias("query_id"), "term").agg(F.sum("tf").alias("qtf"))


def bm25_weight(dedupe_terms: bool = False) -> Weight:
    """Weight of a posting; a query term that stands c times is added c times on top of its own factor, unless ``dedupe_terms``."""

    def query(n_docs, df, qtf):
        return math.log((n_docs + 0.5) / (df + 0.5)) * ((qtf + K2 * qtf) / (qtf + K2)) * (1 if dedupe_terms else qtf)

    return Weight(query, lambda tf, length, avg_len: (tf + K1 * tf) / (tf + K1 * ((1 - B) + B * length / avg_len)))


def default_weight() -> Weight:
    """The usual default similarity of search engines, with exact lengths."""
    return Weight(lambda n_docs, df, qtf: qtf * math.log(1 + (n_docs - df + 0.5) / (df + 0.5)), lambda tf, length, avg_len: (K1 + 1) * tf / (tf + K1 * (1 - B + B * length / avg_len)))


def ranked(scores: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """Rank by score, ties by document, first ``k`` per query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    out = scores.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def search(index: Index, terms: DataFrame, weight: Weight, k: int, first: int = 1) -> DataFrame:
    """(query_id, doc_id, score, rank): ranks ``first`` to ``k`` of the documents that hold any term of a query (query_id, term, qtf); statistics cover all documents."""
    asked = terms.select("query_id", "term", "qtf").join(index.terms, "term")
    stats = index.stats.first()
    found, whole = first_documents(index.shards, asked, stats["n_docs"], stats["avg_len"], weight, k, first)
    return found if whole else ranked(found.drop("rank"), k).where(F.col("rank") >= first)


def bm25(index: Index, queries: DataFrame, k: int = 200) -> DataFrame:
    """Top ``k`` documents per query: (query_id, doc_id, score, rank)."""
    return search(index, analyzed_queries(queries, list(index.stop), index.stem), bm25_weight(), k)


def default_similarity(index: Index, queries: DataFrame, k: int = 200, first: int = 1) -> DataFrame:
    return search(index, analyzed_queries(queries, list(index.stop), index.stem), default_weight(), k, first)


def page_of_hits(index: Index, queries: DataFrame, first: int, last: int) -> DataFrame:
    """Hits of ranks ``first`` to ``last``, as a scrolled search gives them."""
    return default_similarity(index, queries, last, first)


def term_lookup(index: Index, term: str) -> DataFrame:
    """Postings (doc_id, term, tf) of one exact term of the index."""
    return unpack(index.shards, term).select("doc_id", "term", "tf")


def match_all(docs: DataFrame, *fields: str) -> DataFrame:
    """All documents, projected to some fields."""
    return docs.select(*fields)


def root_set(index: Index, words: list[str], k: int = 1000) -> DataFrame:
    """(id): the first ``k`` hits of a topic by the default similarity; fewer if there are fewer.  Its words go through the index's analyzer."""
    spark = index.shards.sparkSession
    terms = term_counts(spark.createDataFrame([("topic", [w.lower() for w in words])], "doc_id string, words array<string>"), list(index.stop), index.stem)
    terms = terms.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    return search(index, terms, default_weight(), k).select(F.col("doc_id").alias("id"))
