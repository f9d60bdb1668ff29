"""Near-duplicate texts by a token-group matrix.

Tokens are hashed runs of three words.  All tokens have one order, rare ones first.  Two texts whose similarity reaches
the threshold share a token among the first ones of either ("prefix"), which is all the matrix has to hold.

* Document counts of tokens are taken by a distributed group-by over 2^COUNTER_BITS counters.  The most frequent tokens,
  as many as LISTED, are given to every task with their counts: all that two texts hold, if they are no more, and stock phrases in any
  case.  Tokens that are not listed are rarer than all listed ones and come first, by their hash.
* Texts are classes of equal texts; similar classes are put into one group (the same rarest shared token
  and a similar size), and groups of very many classes are parted.
* The matrix stores each group's token union: one row per token and group.  Tokens of very many texts are parted, too.
* A class probes the matrix with its prefix.  Its hits in a group's union, plus the tokens behind the prefix,
  bound its overlap with every member: with fewer than m hits no member reaches the least overlap.
* Only groups that qualify are opened, and their members of a fitting size are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seamark.llm.words import WORD, blocks
from seamark.session import cut_lineage, store

#: Words of one token.
SHINGLE = 3
#: Bytes of text that are looked at together.
BLOCK_BYTES = 2 << 20
#: Counters that tokens are counted in; two tokens share one rarely, and then count too high, never too low.
COUNTER_BITS = 40
#: Tokens whose counts all tasks hold (9 bytes each).
LISTED = 4_000_000
#: Sizes within a group differ by less than this factor.
BAND = 1.25
#: A set of n tokens must have 1 + n / HIT_STEP hits in a group before it is opened.
HIT_STEP = 16
#: Classes of a group, on average, beyond which it is parted, and texts of a token beyond which it is.
GROUP_CLASSES, TOKEN_TEXTS = 256, 50_000
#: Lists of classes or groups up to this many are broadcast (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Classes with up to this many ids are written out as all their pairs; larger ones as a star around their first id.
FULL_CLASS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def token_sets(texts: list[str | None], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word runs of every text, one text after the other, and their numbers."""
    docs = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    n = int(sizes.sum())
    word = np.fromiter((h for d in docs for h in map(known.__getitem__, d)), dtype=np.uint64, count=n)
    doc = np.repeat(np.arange(len(docs)), sizes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(len(docs), np.int64)
    run = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        run = _mix(run + word[k : n - size + 1 + k])
    inside = doc[: n - size + 1] == doc[size - 1 :]
    run, doc = run[inside], doc[: n - size + 1][inside]
    turn = np.lexsort((run, doc))
    run, doc = run[turn], doc[turn]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return run[new], np.bincount(doc[new], minlength=len(docs))


def _tokenize(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for block in blocks(batches, "text", BLOCK_BYTES):
            flat, n = token_sets(block.column("text").to_pylist(), size, known)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("rep"), pa.array(n, pa.int32()), lists], names=["rep", "n", "tokens"])

    return run


def text_classes(df: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts: (rep, text) with the smallest key of each, and members (key, rep).  Null keys and texts are left out."""
    data = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    # equal digests of 256 bits are equal texts
    data = data.select("key", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    classes = data.groupBy("digest").agg(F.min("key").alias("rep"), F.first("text").alias("text"))
    members = data.groupBy("digest", "key").agg(F.lit(1).alias("one")).join(classes.select("digest", "rep"), "digest").select("key", "rep")
    return classes.select("rep", "text"), members


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _log(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, in steps of a twelfth of a doubling."""
    return np.minimum(1 + np.round(12 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def frequent_tokens(sets: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Counters of the most frequent tokens in order, their counts as bytes, and the least count that is listed.

    Tokens that are not listed are held by fewer texts than that; if it is two, by one text only.
    """
    most = most or LISTED
    counter = F.shiftrightunsigned(F.col("token"), 64 - COUNTER_BITS)
    per = sets.select(F.explode("tokens").alias("token")).groupBy(counter.alias("counter")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    per = store(per)
    # how many have a count of 2^k or more; at most 64 rows
    steps = {r["k"]: r["c"] for r in per.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, listed = 2, sum(steps.values())
    for k in sorted(steps):
        if listed <= most:
            break
        least, listed = 2 ** (k + 1), listed - steps[k]
    got = per.where(F.col("n") >= least).toArrow()  # at most ``most`` rows
    keys, counts = got.column("counter").to_numpy(), got.column("n").to_numpy()
    turn = np.argsort(keys)
    return keys[turn], _log(counts[turn]), least


def _hits_wanted(n):
    """m of the prefix rule for sets of n tokens (a number or an array)."""
    return 1 + n // HIT_STEP


def _order(shared, threshold: float):
    """Prefix of each class: its tokens as places in the common order, the position of the first, how many of them are indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, least = shared.value
        unlisted = int(_log(np.array([least - 1]))[0])
        for batch in batches:
            n = np.asarray(batch.column("n"), np.int64)
            tokens = np.asarray(pc.list_flatten(batch.column("tokens"))).view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            seen = np.full(len(tokens), unlisted, np.int64)
            if len(keys):
                counter = _counter(tokens)
                at = np.minimum(np.searchsorted(keys, counter), len(keys) - 1)
                found = keys[at] == counter
                seen[found] = logs[at[found]]
            place = (seen << 55) | (_mix(tokens) >> np.uint64(9)).astype(np.int64)
            turn = np.lexsort((place, row))
            place, seen = place[turn], seen[turn]
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            # against smaller sets, and as the smaller set
            probe = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + _hits_wanted(n)
            index = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + _hits_wanted(n)
            # a token that no other text holds is one of the first, and can be left out
            alone = np.bincount(row[seen <= 1], minlength=len(n))
            keep = (pos < probe[row]) & (pos >= alone[row])
            held = np.bincount(row[keep], minlength=len(n))
            some = np.flatnonzero(held)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held[some])), pa.int32()), pa.array(place[keep]))
            first = place[keep][(np.cumsum(held) - held)[some]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(pa.array(some)), pa.array(n[some], pa.int32()), pa.array(alone[some], pa.int32()), pa.array(np.clip(index - alone, 0, held)[some], pa.int32()), lists, pa.array(first)],
                names=["cid", "n", "start", "indexed", "tokens", "first"],
            )

    return run


def size_band(n: Column) -> Column:
    """Number of the band of set sizes, each BAND times as wide as the one before."""
    return F.floor(F.log(n.cast("double")) / math.log(BAND) + 1e-9)


def _small(rows: DataFrame) -> DataFrame:
    """A kept list, to be broadcast if it is short enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


class NearDuplicates:
    """Linked classes of equal texts.

    ``members`` (key, rep) has every key with its class, named by the smallest key of the class, and
    ``pairs`` (rep_a, rep_b, similarity) the linked classes, rep_a < rep_b.  Null keys and null texts are left
    out; texts with fewer words than a token form classes but match nothing, not even their equals.
    """

    def __init__(self, df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.5, shingle: int = SHINGLE):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.threshold = threshold
        classes, members = text_classes(df, key, text)
        self.members = store(members)
        kind = classes.schema["rep"].dataType.simpleString()
        sets = classes.mapInArrow(_tokenize(shingle), f"rep {kind}, n int, tokens array<long>").where("n > 0")
        self.sets = store(sets.withColumn("cid", F.monotonically_increasing_id()))
        self.pairs = self._compare(self._open(self._matrix()))

    def _matrix(self) -> DataFrame:
        """Prefixes of all classes with their groups: cid, n, start (position of the first token), indexed (so many of them), tokens, gid."""
        shared = self.sets.sparkSession.sparkContext.broadcast(frequent_tokens(self.sets))
        kinds = "cid long, n int, start int, indexed int, tokens array<long>, first long"
        prefix = self.sets.select("cid", "n", "tokens").mapInArrow(_order(shared, self.threshold), kinds)
        # similar classes are a group: the same rarest token that anything else may hold, and sizes within a quarter
        prefix = store(prefix.withColumn("gid", F.xxhash64("first", size_band(F.col("n")))).drop("first"))
        large = cut_lineage(prefix.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP_CLASSES))
        part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / GROUP_CLASSES))
        return prefix.join(_small(large), "gid", "left").withColumn("gid", F.when(F.col("c").isNull(), F.col("gid")).otherwise(F.xxhash64("gid", part))).drop("c")

    def _open(self, prefix: DataFrame) -> DataFrame:
        """Candidate pairs (a, b): members of the groups that qualify for a, none larger than a."""
        t = self.threshold
        # the parts of a token follow from its count, which stands in its place in the order
        parts = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), (F.shiftright("token", 55) - 1) / 12) / TOKEN_TEXTS)).cast("int")
        indexed = prefix.select("gid", "n", "start", F.posexplode(F.slice("tokens", F.lit(1), F.col("indexed"))).alias("p", "token"))
        # how far before a member's end the token stands, the most of all members that hold it; and the bounds of the group's sizes
        union = indexed.select("token", F.pmod("gid", parts).cast("int").alias("part"), "gid", "n", (F.col("n") - F.col("start") - F.col("p")).alias("rest"))
        union = union.repartition("token", "part").groupBy("token", "part", "gid").agg(F.max("rest").alias("rest"), F.max("n").alias("n"))
        band = size_band(F.col("n"))
        union = union.select("token", "part", "gid", "rest", F.ceil(F.pow(F.lit(BAND), band) - 1e-6).alias("least"), F.floor(F.pow(F.lit(BAND), band + 1) + 1e-6).alias("most"))
        probes = prefix.select("cid", "n", "start", F.posexplode("tokens").alias("p", "token")).select("token", "cid", "n", (F.col("start") + F.col("p")).alias("pos"))
        probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        smaller = F.greatest("least", F.ceil(F.col("n") * t - 1e-9))
        need = F.ceil(F.lit(t / (1 + t)) * (F.col("n") + smaller) - 1e-9)
        wanted = 1 + F.floor(F.col("least") / HIT_STEP)
        hits = probes.join(union, ["token", "part"]).where(
            (F.col("least") <= F.col("n")) & (F.col("most") >= F.col("n") * t - 1e-9) & (F.least(F.col("n") - F.col("pos"), F.col("rest")) > need - wanted)
        )
        bound = hits.groupBy("cid", "gid").agg(F.first("n").alias("n_a"), F.first("least").alias("least"), F.count(F.lit(1)).alias("c"))
        opened = bound.where(F.col("c") >= wanted).select("cid", "gid", "n_a")
        members = prefix.where("indexed > 0").select("gid", F.col("cid").alias("b"), F.col("n").alias("n_b"))
        fits = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("cid")))
        return opened.join(members, "gid").where(fits & (F.col("n_b") >= F.col("n_a") * t - 1e-9)).select(F.col("cid").alias("a"), "b")

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets reach the threshold; only sets of classes in a pair are moved."""
        pairs = store(pairs)
        asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        sets = self.sets.join(_small(asked), "cid", "left_semi")
        left = sets.select(F.col("cid").alias("a"), F.col("rep").alias("rep_x"), F.col("tokens").alias("x"))
        right = sets.select(F.col("cid").alias("b"), F.col("rep").alias("rep_y"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        scored = pairs.join(left, "a").join(right, "b").select("rep_x", "rep_y", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
        return scored.where(F.col("similarity") >= self.threshold).select(F.least("rep_x", "rep_y").alias("rep_a"), F.greatest("rep_x", "rep_y").alias("rep_b"), "similarity")

    def key_pairs(self, full_class: int | None = -1) -> DataFrame:
        """Distinct pairs id_a < id_b (byte order) of keys whose texts reach the threshold.

        Members of linked classes are paired, and so are the keys of one class (equal texts).  A class of
        more than ``full_class`` keys (FULL_CLASS if not given) is a star instead, and linked by its first key, so that copies do not
        square; ``members`` and ``pairs`` have them all.  With None every pair is written out.  A key with several texts matches by any of them.
        """
        most = FULL_CLASS if full_class == -1 else full_class
        members = self.members.join(self.sets.select("rep"), "rep", "left_semi")
        sized = members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "rep")
        full = F.lit(True) if most is None else F.col("size") <= most
        some = sized.where(full | (F.col("key") == F.col("rep"))).select("rep", "key")
        a, b = some.select(F.col("rep").alias("rep_a"), F.col("key").alias("x")), some.select(F.col("rep").alias("rep_b"), F.col("key").alias("y"))
        linked = self.pairs.join(a, "rep_a").join(b, "rep_b").select("x", "y")
        several = sized.where("size > 1")
        star = several.select(F.col("rep").alias("x"), F.col("key").alias("y"))
        rest = several.where(full & (F.col("key") != F.col("rep")))
        inner = rest.select("rep", F.col("key").alias("x")).join(rest.select("rep", F.col("key").alias("y")), "rep").select("x", "y")
        every = linked.unionByName(star).unionByName(inner).where("x <> y")
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def classes(self) -> DataFrame:
        """Every key with its class: key, rep, and n_links of the class to other classes."""
        links = self.pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        return self.members.join(links, "rep", "left").fillna(0, ["n_links"]).select("key", "rep", "n_links")
