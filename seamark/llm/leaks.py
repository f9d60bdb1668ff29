"""Passages of held-out test items inside a training corpus.

The corpus is read in shards (blocks of documents).  A shard builds a suffix array over its words; words
that no test item has end a sequence, and sequences shorter than the least passage are left out, as they
can't hold one.  Every suffix of every test item is then looked up by binary search in the sorted
suffixes, word by word, for all suffixes at once; what is left after RUN words are verbatim matches,
which are extended to their full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.llm.words import Numbers, blocks, suffix_array, words

#: Words of the least passage that counts.
RUN = 12
#: Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Characters of test texts that a task holds at a time; more are taken in several parts, one after the other past the same shards.
TEST_CHARS = 20_000_000
#: Bytes of corpus text that are kept for all parts, if there are several.
KEPT_BYTES = 16 << 20


class HeldOut:
    """Word numbers (from 1) and all suffixes of at least ``run`` words of the test items."""

    def __init__(self, items: list[tuple], run: int):
        self.run, self.numbers = run, Numbers()
        self.numbers[None] = 0
        seqs = [[self.numbers[w] for w in words(text)] for _, text in items]
        sizes = np.array([len(s) for s in seqs], np.int64)
        self.flat = np.array([x for s in seqs for x in s], np.int64)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.ids = [i for i, _ in items]
        self.starts = np.flatnonzero(self.ends - np.arange(len(self.flat)) >= run)

    def search(self, docs: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(document index, item index, longest passage in words, its first word in the document from 0) per pair that shares a passage."""
        sizes = np.array([len(d) for d in docs], np.int64)
        n = int(sizes.sum())
        get = self.numbers.get
        flat = np.fromiter((get(w, 0) for d in docs for w in d), dtype=np.int64, count=n)
        doc = np.repeat(np.arange(len(docs)), sizes)
        first_word = np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a sequence ends at an unknown word and at the document's end
        stop = flat == 0
        stop[1:] |= doc[1:] != doc[:-1]
        seq = np.cumsum(stop)
        known = flat > 0
        long = np.bincount(seq[known], minlength=(seq[-1] + 1 if n else 1)) >= self.run
        keep = np.flatnonzero(known & long[seq]) if n else np.zeros(0, np.int64)
        if not len(keep):
            return []
        w, s = flat[keep], seq[keep]
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) + 1
        ends = last[np.searchsorted(last, np.arange(len(w)), "right")]
        order = suffix_array(w, ends, depth=self.run)
        test, lo, hi = self._bisect(w, ends, order)
        return self._pairs(test, lo, hi, w, ends, order, doc[keep], (keep - first_word[keep]))

    def _bisect(self, w, ends, order):
        """Interval of the sorted suffixes that begin with the RUN words of each test suffix that has any."""
        test = self.starts
        lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(order), np.int64)
        for depth in range(self.run):
            at = order + depth
            # the word at this depth; 0 where the suffix has ended, which sorts first
            column = np.where(at < ends[order], w[np.minimum(at, len(w) - 1)], 0)
            want = self.flat[test + depth]
            lo, hi = _edge(column, want, lo, hi, False), _edge(column, want, lo, hi, True)
            live = lo < hi
            test, lo, hi = test[live], lo[live], hi[live]
        return test, lo, hi

    def _pairs(self, test, lo, hi, w, ends, order, doc, place) -> list[tuple[int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        step = 1_000_000  # matches that are looked at together
        counts = np.cumsum(hi - lo)
        begin = 0
        while begin < len(test):
            end = max(begin + 1, int(np.searchsorted(counts, (counts[begin - 1] if begin else 0) + step, "right")))
            width = (hi - lo)[begin:end]
            t = np.repeat(test[begin:end], width)
            p = order[np.repeat(lo[begin:end] - np.cumsum(width) + width, width) + np.arange(width.sum())]
            # matches that go on to the left are found from there
            left = (t > 0) & (p > 0) & (self.item[t - 1] == self.item[t]) & (ends[p - 1] == ends[p]) & (self.flat[t - 1] == w[p - 1])
            t, p = t[~left], p[~left]
            length = np.full(len(t), self.run, np.int64)
            live = np.arange(len(t))
            while len(live):
                a, b = t[live] + length[live], p[live] + length[live]
                live = live[(a < self.ends[t[live]]) & (b < ends[p[live]])]
                a, b = t[live] + length[live], p[live] + length[live]
                live = live[self.flat[a] == w[b]]
                length[live] += 1
            turn = np.lexsort((place[p], -length, self.item[t], doc[p]))
            d, i = doc[p][turn], self.item[t][turn]
            head = np.ones(len(turn), bool)
            head[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
            for dd, ii, ll, pp in zip(d[head].tolist(), i[head].tolist(), length[turn][head].tolist(), place[p][turn][head].tolist()):
                best[dd, ii] = max(best.get((dd, ii), (0, 0)), (ll, -pp))
            begin = end
        return [(d, i, n, -p) for (d, i), (n, p) in best.items()]


def _edge(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted word in its own interval of the column."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        seen = column[mid]
        below = seen <= want[open_] if right else seen < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def leaked_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", run: int = RUN) -> DataFrame:
    """Pairs of document and test item that share at least ``run`` consecutive words.

    Columns: key, item key, n_words of the longest shared passage, first_word of it in the document
    (from 0).  Null and empty texts share nothing, as do items of fewer words; rows with null keys are
    searched like others, repeated rows give repeated pairs.  Test texts are held by every task in
    parts of bounded size, so any number of items can be searched for in one reading of the corpus.
    """
    spark = documents.sparkSession
    data = documents.select(F.col(f"`{key}`").alias("key"), F.col("text").alias("text"))
    tests = items.select(F.col(f"`{item_key}`").alias("item"), F.col("text").alias("text")).where("text IS NOT NULL")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    many = 1 + chars // TEST_CHARS
    kinds = f"key {data.schema['key'].dataType.simpleString()}, item {tests.schema['item'].dataType.simpleString()}, n_words int, first_word int"
    parts = []
    for k in range(many):
        part = tests if many == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k)
        parts.append(spark.sparkContext.broadcast(HeldOut([(r["item"], r["text"]) for r in part.collect()], run)))  # TEST_CHARS on average
    found = data.where("text IS NOT NULL").mapInArrow(_search(parts), kinds)
    return found.withColumnsRenamed({"key": key, "item": item_key})


def _search(parts: list):
    """Function for mapInArrow over key and text, with the broadcast parts of the test items; the corpus is read and cut into words once."""

    def look(held: list[tuple[pa.RecordBatch, list[list[str]]]]) -> Iterator[pa.RecordBatch]:
        for shared in parts:
            tests = shared.value
            for block, docs in held:
                hits = tests.search(docs)
                if hits:
                    d, i, n, p = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [block.column("key").take(pa.array(d)), pa.array([tests.ids[x] for x in i]), pa.array(n, pa.int32()), pa.array(p, pa.int32())],
                        names=["key", "item", "n_words", "first_word"],
                    )
            if len(parts) > 1:
                del tests
                shared.__dict__.pop("_value", None)  # read again from the worker's disk when its turn comes, so that one part is held at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, "text", SHARD_BYTES):
            held.append((block, [words(x) for x in block.column("text").to_pylist()]))
            size += block.column("text").nbytes
            if len(parts) == 1 or size >= KEPT_BYTES:
                yield from look(held)
                held, size = [], 0
        yield from look(held)

    return run


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Distinct (doc_id, item_id) that share a passage."""
    return leaked_passages(documents, items, run=run).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """The documents that share no passage with a test item; those with a null id are kept."""
    return documents.join(leaks(documents, items, run).select("doc_id").distinct(), "doc_id", "left_anti")
