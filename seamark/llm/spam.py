"""Pages of stuffed keywords, bare link lists or product tags instead of sentences.

Evidence is taken from the page's own body (its text without the site's frame):

* list density: the share of words that stand in no real sentence.  By its form a sentence has an end mark of any
  script, at least five words, and says something new: most of its word pairs are new on the page.
* phrase replication: the three-word phrases of all sentences are exploded and their hosts counted.  Language is made of
  phrases that others use too; a sentence that has far fewer of them than is usual in the corpus strings words together and is
  none.  What is usual is measured, so that it follows the size and the languages of the corpus, and no list of words is used.
* where most words of a page stand on no other host its language is not known, so phrases can't tell and form decides.
* the number of distinct outlinks, for pages on the border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamark.llm.boilerplate import main_text
from seamark.llm.neardup import WordHashes, _mix
from seamark.llm.words import blocks
from seamark.session import cut_lineage, store

#: Words of a phrase.
PHRASE = 3
#: Pages of fewer words of their own are short pages, whatever they hold.
LEAST_WORDS = 40
#: A page with a lower share of words in sentences is spam; below the second share it is if it is mostly links.
SENTENCES, DOUBTFUL = 0.2, 0.22
#: Outlinks per word of a page of links.
LINKS_PER_WORD = 0.5
#: Share of new word pairs that a sentence has at least, and its least number of words.
NEW_PAIRS, SENTENCE_WORDS = 0.5, 5
#: A sentence has at least this part of the usual (median) share of replicated phrases.
USUAL = 0.5
#: A page's language is known if at least this share of its distinct words stands on two hosts or more.
KNOWN_WORDS = 0.5
BLOCK_BYTES = 2 << 20

# Scripts that don't part words: each of their characters counts as a word (Thai to Lao, Burmese, Khmer, kana, Han).
_JOINED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_JOINED}]|[^\W_{_JOINED}]+")
#: Ends of sentences (with what closes them) and of lines.
_END = re.compile(r"([.!?…։؟۔।॥]+[\"'”’»)\]]*(?=\s)|[.!?…։؟۔।॥]+[\"'”’»)\]]*$|[。！？｡]+|\n)")


def sentences(bodies: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of all bodies in order; per word its body and its segment (sentence or rest of a line); per segment its body and whether it is a sentence by its form."""
    word: list[int] = []
    sizes: list[int] = []
    owner: list[int] = []
    ended: list[bool] = []
    for k, body in enumerate(bodies):
        parts = _END.split(body.lower())
        for text, mark in zip(parts[::2], [*parts[1::2], "\n"]):
            found = _TOKEN.findall(text)
            if found:
                word.extend(map(known.__getitem__, found))
                sizes.append(len(found))
                owner.append(k)
                ended.append(mark != "\n")
    w, n, page = np.array(word, np.uint64), np.array(sizes, np.int64), np.array(owner, np.int64)
    segment = np.repeat(np.arange(len(n)), n)
    doc = page[segment] if len(n) else np.zeros(0, np.int64)
    if len(w) < 2:
        return w, doc, segment, page, np.zeros(len(n), bool)
    # a pair of words is new where it stands first on its page
    within = segment[1:] == segment[:-1]
    pair = _mix(_mix(w[:-1]) + w[1:])[within]
    at, of = doc[1:][within], segment[1:][within]
    turn = np.lexsort((np.arange(len(pair)), pair, at))
    first = np.ones(len(pair), bool)
    first[1:] = (pair[turn][1:] != pair[turn][:-1]) | (at[turn][1:] != at[turn][:-1])
    fresh = np.zeros(len(pair), bool)
    fresh[turn] = first
    new = np.bincount(of[fresh], minlength=len(n))
    return w, doc, segment, page, np.array(ended) & (n >= SENTENCE_WORDS) & (new >= NEW_PAIRS * (n - 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()

    def lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=n))), pa.int32()), values)

    for block in blocks(batches, "body", BLOCK_BYTES):
        many = block.num_rows
        w, doc, segment, page, good = sentences(block.column("body").to_pylist(), known)
        size = np.bincount(segment, minlength=len(page)).astype(np.int64)
        place = np.flatnonzero(good)  # sentences, in order of their pages
        run = np.zeros(max(len(w) - PHRASE + 1, 0), np.uint64)
        for k in range(PHRASE):
            run = _mix(run + w[k : k + len(run)])
        whole = (segment[: len(run)] == segment[PHRASE - 1 :]) & good[segment[: len(run)]] if len(run) else np.zeros(0, bool)
        number = np.cumsum(good) - 1 - np.repeat(np.append(0, np.cumsum(np.bincount(page[place], minlength=many)))[:-1], np.bincount(page, minlength=many)) if len(page) else np.zeros(0, np.int64)
        phrases = pa.StructArray.from_arrays([pa.array(number[segment[: len(run)][whole]], pa.int32()), pa.array(run[whole].view(np.int64))], names=["s", "phrase"])
        turn = np.lexsort((w, doc))
        distinct = np.ones(len(w), bool)
        distinct[1:] = (w[turn][1:] != w[turn][:-1]) | (doc[turn][1:] != doc[turn][:-1])
        yield pa.RecordBatch.from_arrays(
            [
                block.column("id"), pa.array(np.bincount(doc, minlength=many), pa.int32()), lists(page[place], pa.array(size[place], pa.int32()), many),
                lists(doc[: len(run)][whole], phrases, many), lists(doc[turn][distinct], pa.array(w[turn][distinct].view(np.int64)), many),
            ],
            names=["id", "n_words", "sizes", "phrases", "words"],
        )


_KINDS = "n_words int, sizes array<int>, phrases array<struct<s:int,phrase:long>>, words array<long>"


def replicated(items: DataFrame, item: str) -> DataFrame:
    """(item) that stand on two hosts or more: the least and the greatest host differ."""
    return items.groupBy(item).agg(F.min("host").alias("lo"), F.max("host").alias("hi")).where("lo <> hi").select(item)


def page_evidence(pages: DataFrame, replication: bool = True) -> DataFrame:
    """Evidence of every page with a text: id, n_words, sentence_share, replicated_share, n_outlinks.

    ``sentence_share`` is the share of words in real sentences, ``replicated_share`` that of phrases in sentences by form that stand on
    two hosts or more.  Shares are 0 where there is nothing to share.  Without ``replication`` form alone makes a sentence.
    """
    spark = pages.sparkSession
    body = main_text(pages)
    kind = body.schema["id"].dataType.simpleString()
    # whole texts go to Python in even parts, as many as the scan has or two a core
    parts = max(pages.select("id").rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    found = body.repartition(parts).mapInArrow(_features, f"id {kind}, {_KINDS}")
    host = F.hash(F.regexp_extract("id", r"^[a-zA-Z]+://([^/]*)", 1))
    found = store(found.withColumns({"host": host, "rid": F.monotonically_increasing_id()}))
    per = found.select("rid", F.posexplode("sizes").alias("s", "size"))
    postings = found.select("rid", "host", F.explode("phrases").alias("x")).select("rid", "host", "x.s", "x.phrase")
    hits = postings.select("rid", "s", "phrase").join(replicated(postings, "phrase"), "phrase").groupBy("rid", "s").agg(F.count(F.lit(1)).alias("hits"))
    scored = per.join(hits, ["rid", "s"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    share = F.col("hits") / (F.col("size") - (PHRASE - 1))
    scored = cut_lineage(scored.select("rid", "size", "hits", share.alias("share")))
    usual = F.broadcast(scored.agg(F.coalesce(F.percentile_approx("share", 0.5, 10_000), F.lit(0.0)).alias("usual")))  # one row
    real = F.sum(F.when(F.col("share") >= F.col("usual") * USUAL, F.col("size")).otherwise(0))
    page = scored.crossJoin(usual).groupBy("rid").agg(real.alias("real"), F.sum("size").alias("formal"), F.sum("hits").alias("hits"), F.sum(F.col("size") - (PHRASE - 1)).alias("n_phrases"))
    one = found.select("rid", "id", "n_words").join(page, "rid", "left").fillna(0, ["real", "formal", "hits", "n_phrases"])
    if replication:
        # pages that phrases would turn into spam: do they know the language?
        turned = one.where((F.col("formal") >= SENTENCES * F.col("n_words")) & (F.col("real") < DOUBTFUL * F.col("n_words"))).select("rid")
        common = replicated(found.select("host", F.explode("words").alias("word")), "word")
        words = found.join(turned, "rid", "left_semi").select("rid", F.size("words").alias("n"), F.explode("words").alias("word"))
        strange = words.join(common.withColumn("common", F.lit(1)), "word", "left").groupBy("rid").agg((F.count("common") < KNOWN_WORDS * F.first("n")).alias("strange"))
        one = one.join(strange, "rid", "left").withColumn("good", F.when(F.coalesce("strange", F.lit(False)), F.col("formal")).otherwise(F.col("real")))
    else:
        one = one.withColumn("good", F.col("formal"))
    links = pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.size(F.array_distinct(F.coalesce("outlinks", F.array().cast("array<string>"))))).alias("n_outlinks"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return one.join(links, "id", "left").select(
        "id", "n_words", ratio("good", "n_words").alias("sentence_share"), ratio("hits", "n_phrases").alias("replicated_share"), F.coalesce("n_outlinks", F.lit(0)).alias("n_outlinks")
    )


def spam_pages(pages: DataFrame, replication: bool = True) -> DataFrame:
    """Distinct ids of pages whose body is keywords, links or tags instead of sentences.  Pages without a text are none."""
    e = page_evidence(pages, replication)
    linked = F.col("n_outlinks") >= F.col("n_words") * LINKS_PER_WORD
    return e.where((F.col("n_words") >= LEAST_WORDS) & ((F.col("sentence_share") < SENTENCES) | ((F.col("sentence_share") < DOUBTFUL) & linked))).select("id").distinct()
