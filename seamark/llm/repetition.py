"""Repetition inside single documents, from a suffix array over the words of a block of documents.

Word numbers differ from document to document, so suffixes of different documents never match.
Intervals of the sorted suffixes whose longest common prefixes reach RUN words are the repeated
runs; every occurrence but the first counts, and overlapping occurrences count once.  A text is worked on whole in one task:
one of n words whose longest repeat has r takes some (100 + 4 log2 r) n bytes, so 10 million words take 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.llm.words import Numbers, blocks, suffix_array, words

#: A repeat has at least so many words.
RUN = 5
#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def repeats(docs: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, of repeated words, and length of the longest repeated run, per document."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return sizes, np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    numbers = Numbers()
    flat = np.fromiter((x for d in docs for x in map(numbers.__getitem__, d)), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(docs)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    order, levels = suffix_array(doc * len(numbers) + flat, ends, levels=True)
    one, two = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in reversed(range(len(levels))):
        a, b = one + common, two + common
        live = np.flatnonzero((a < ends[one]) & (b < ends[two]) & (doc[one] == doc[two]))
        # equal ranks of suffixes that are longer than 2^k mean equal words; shorter ones have ranks of their own
        same = live[levels[k][a[live]] == levels[k][b[live]]]
        common[same] += 1 << k
    longest = np.zeros(len(docs), np.int64)
    np.maximum.at(longest, doc[one], np.where(common >= run, common, 0))
    # intervals of suffixes that share RUN words: all but the earliest start repeat
    interval = np.concatenate([[0], np.cumsum(common < run)])
    first = np.full(interval[-1] + 1, n, np.int64)
    np.minimum.at(first, interval, order)
    again = order[order != first[interval]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return sizes, np.bincount(doc[covered], minlength=len(docs)), longest


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        n, again, longest = repeats([words(x) for x in block.column("text").to_pylist()])
        share = np.divide(again, n, out=np.zeros(len(n)), where=n > 0)
        yield pa.RecordBatch.from_arrays(
            [block.column("key"), pa.array(n), pa.array(again), pa.array(share), pa.array(longest)],
            names=["key", "n_words", "repeated_words", "repeated_share", "longest_repeat"],
        )


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_words, repeated_words, repeated_share, longest_repeat (words, 0 if none).

    A word is repeated if it lies in a run of five words that has begun earlier in the same text.
    Null, empty and wordless texts have 0 words and a share of 0; a null key stays null, equal keys stay apart.
    """
    data = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = data.schema["key"].dataType.simpleString()
    out = data.mapInArrow(_measure, f"key {kind}, n_words long, repeated_words long, repeated_share double, longest_repeat long")
    return out.withColumnRenamed("key", key)


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.3, least_words: int = 20) -> DataFrame:
    """Distinct keys of texts of at least ``least_words`` words of which ``share`` or more are repeated."""
    m = repetition(df, key, text)
    return m.where((F.col("n_words") >= least_words) & (F.col("repeated_words") >= F.lit(share) * F.col("n_words") - 1e-9)).select(key).distinct()
