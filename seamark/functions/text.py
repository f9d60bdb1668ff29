"""Text analysis: tokens, stop words, stems and query refinement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"
#: A text of Latin-1, the spaces, dashes and quotes of U+2000 to U+203F, and the euro sign.  Looking for another character instead takes ten times as long.
LATIN = r"\A[\u0000-\u00FF\u2000-\u203F\u20AC]*+\z"
# what the bytes of Latin texts are in UTF-8: letters and digits, in lower case; of the two bytes from U+0080 on, the second ones
_ASCII = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_AFTER_C2 = np.isin(np.arange(256), [ord(c) for c in "ªµº²³¹¼½¾"])
_AFTER_C3 = ~np.isin(np.arange(256), [ord(c) - 0x40 for c in "×÷"])

# Words, and stems, that query refinement drops.
REFINE_WORDS = (
    "any anticipate air actual area application basis cite current contrast controversy discuss document Document directly describe develop "
    "event exist group include identify instances location level least method make motivation one predict prediction product pending "
    "perpetrated platform report role result solely second some system side specific success since something support study taken type "
    "water will worldwide"
).split()
REFINE_STEMS = [*"side action actual ha studi system someth motiv perpetr ongo measur specifi unsubstanti product level contrast standard make preliminari exist take".split(), ""]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept; none for null."""
    # only the first and the last part can be empty
    return F.coalesce(F.array_remove(F.split(F.lower(text), BETWEEN_TOKENS), ""), F.array().cast("array<string>"))


def latin_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of texts that match LATIN: the same tokens as ``tokens`` gives, from the bytes of all texts at once."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    ends = ends - ends[0]
    word, low = _ASCII[data], _LOWER[data]
    two = np.flatnonzero((data & 0xFE) == 0xC2)  # U+0080 to U+00FF; all others of two bytes and more part tokens
    second = data[two + 1]
    after_c3 = (data[two] == 0xC3) & _AFTER_C3[second]
    word[two] = word[two + 1] = after_c3 | (data[two] == 0xC2) & _AFTER_C2[second]
    low[two[after_c3 & (second < 0x9F)] + 1] += 0x20
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    # a token ends where its text does
    cut = np.unique(ends[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[word[cut] & word[cut - 1]]
    if len(cut):
        starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
    row = np.repeat(np.arange(len(texts)), np.diff(starts.searchsorted(ends)))
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(wide)
    return row, pa.Array.from_buffers(texts.type, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[word])])


def without(terms: Column, words: list[str]) -> Column:
    """Terms that are not among ``words``; exact case, order and repeats kept."""
    return F.filter(terms, lambda x: ~x.isin(*words)) if words else terms


def refined_tokens(text: Column) -> Column:
    """Tokens of a query text: commas and quotes deleted, given words dropped, the rest analysed.  Stems are dropped after stemming (see ``search.analyzed_queries``)."""
    words = F.split(F.translate(text, ',"', ""), " ")
    return tokens(F.array_join(without(words, REFINE_WORDS), " "))


def _shape(word: str) -> str:
    """Letters as v and c; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# Suffix tables of the published algorithm (Porter, 1980).
_STEP2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
).split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Stem of a lower-case word; words of up to two letters and with other characters than a to z stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # plurals, past and progressive forms
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in _shape(word[: -len(x)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((x for x in table if word.endswith(x)), key=len, default=None)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = max((x for x in _STEP4 if word.endswith(x)), key=len, default=None)
    if end:
        stem = word[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


class Stems(dict):
    """Stem of each word, remembered while there is room."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = s = porter(word)
        return s


def term_counts(docs: DataFrame, stop: list[str] | None = None, stem: bool = False, stop_first: bool = False) -> DataFrame:
    """(doc_id, len, term, tf) of (doc_id, words), counted row by row where the rows lie; len is the number of terms that are kept.

    The analyzer stems, then drops stop words; ``stop_first`` turns that round.  Only the distinct words of a
    batch are stemmed.  Rows without terms give nothing.
    """
    drop = frozenset(stop or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, code, tf, length, terms in counted(batches, drop, stem, stop_first):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(length[row], pa.int64()), terms.take(pa.array(code)), pa.array(tf, pa.int64())], names=["doc_id", "len", "term", "tf"]
            )

    return docs.select("doc_id", "words").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, len long, term string, tf long")


def counted(batches: Iterator[pa.RecordBatch], drop: frozenset = frozenset(), stem: bool = False, stop_first: bool = False) -> Iterator[tuple]:
    """(batch, row, code, tf, length, terms) of batches of (doc_id, words): the row, the place among ``terms`` and the count of each posting, and the length of each row.

    Batches of (doc_id, words, text) have the words of those texts only that do not match LATIN.
    """
    stems = Stems()
    for batch in batches:
        column = batch.column("words")
        at = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))
        coded = pc.list_flatten(column)
        if "text" in batch.schema.names:
            text = batch.column("text")
            plain, own = latin_tokens(text if column.null_count == len(column) else pc.if_else(pc.is_null(column), text, pa.scalar(None, text.type)))
            at, coded = np.concatenate([at, plain]), pa.concat_arrays([coded, own])
        coded = coded.dictionary_encode()
        if not len(coded):
            continue
        words = coded.dictionary.to_pylist()
        if stop_first:
            words = [None if w in drop else w for w in words]
        if stem:
            words = [None if w is None else stems[w] for w in words]
        if not stop_first:
            words = [None if w in drop else w for w in words]
        terms = pa.array(words, pa.string()).dictionary_encode()
        code = np.asarray(pc.fill_null(terms.indices, -1), np.int64)[np.asarray(coded.indices)]
        row = at[code >= 0]
        code, many = code[code >= 0], max(len(terms.dictionary), 1)
        length = np.bincount(row, minlength=batch.num_rows)
        both, tf = np.unique(row * many + code, return_counts=True)
        yield batch, both // many, both % many, tf, length, terms.dictionary
