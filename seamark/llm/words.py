"""Words of a text and blocks of documents, for operators that work on word sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text; none for null and for texts without letters and digits."""
    return WORD.findall(text.lower()) if text else []


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block's texts have about ``most`` bytes or are one long text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        lo, done = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo, done = hi, int(ends[hi - 1])


def suffix_array(words_of: np.ndarray, ends: np.ndarray, levels: bool = False, depth: int | None = None):
    """Suffixes of word sequences in order, by refining ranks over doubled lengths.

    ``words_of`` are word numbers, ``ends`` gives for each position the end of its sequence; a suffix
    ends with its sequence and sorts before its extensions.  Only groups of still equal suffixes are
    sorted again.  With ``depth`` the order is settled by that many words at least.  Returns the sorted
    positions, and with ``levels`` also the ranks after 1, 2, 4, ... words (equal rank: equal so far).
    """
    n = len(words_of)
    order = np.argsort(words_of, kind="stable")
    key = words_of[order]
    rank = np.empty(n, np.int64)
    start = _starts(key)
    rank[order] = start
    small = np.int32 if n < 1 << 31 else np.int64  # levels take most of the memory
    kept = [rank.astype(small)] if levels else []
    active = order[_crowded(start)]
    step = 1
    while len(active) and (depth is None or step < depth):
        behind = active + step
        inside = behind < ends[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[behind[inside]] + 1
        old = rank[active]
        turn = np.lexsort((second, old))
        active, old, second = active[turn], old[turn], second[turn]
        begin = _starts(old)
        new = np.ones(len(active), bool)
        new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        fresh = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank[active] = old + fresh - begin
        active = active[_crowded(fresh)]
        step *= 2
        if levels:
            kept.append(rank.astype(small))
    order = np.argsort(rank, kind="stable")
    return (order, kept) if levels else order


def _starts(key: np.ndarray) -> np.ndarray:
    """Index where each element's run of equal keys starts."""
    if not len(key):
        return np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _crowded(start: np.ndarray) -> np.ndarray:
    """Which elements share their run with another."""
    same = np.zeros(len(start), bool)
    if len(start) > 1:
        twin = start[1:] == start[:-1]
        same[1:] |= twin
        same[:-1] |= twin
    return same
