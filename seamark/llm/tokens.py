"""Token ids of a whole corpus by a public byte-level BPE, with content-defined chunk reuse.

1. A rolling hash over the bytes proposes cuts, so equal passages are cut alike wherever they stand.
   A proposed cut moves to the next place, within REACH bytes, where the tokenizer parts words in any
   context; if there is none, the text is cut all the same and the join is marked.
2. Hashes of the chunks meet, not the chunks: where one stands more than once, its first place owns it.  The texts are
   then encoded where they lie.  A text all of whose chunks are its own alone is encoded in one go; else every chunk is encoded
   by its owner only and its ids are joined to the other places, so each distinct chunk is encoded once in the whole corpus.
3. Texts with chunks from elsewhere are put together again.  At a marked join, the stretch from the last certain word end before
   it to the first one after it is encoded again; the ids on both sides must then end exactly there,
   or the stretch grows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seamark.session import cut_lineage, store

# Fixed values of the public vocabulary: how its tokenizer parts a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes the rolling hash sees, and bits of it that are zero at a cut (one cut in 2^CUT_BITS bytes).
WINDOW, CUT_BITS = 16, 10
#: Least bytes of a chunk, and bytes that a cut may move to a certain word end.
LEAST, REACH = 256, 512
#: Places of shared chunks that are broadcast (about 40 bytes each); longer lists are joined by a shuffle of the texts.
BROADCAST_PLACES = 1_000_000
#: Places from which on a chunk is hot, and most hot chunks there are (a chunk has some 1,000 bytes); their ids are broadcast to the places that take them.
HOT_PLACES, MOST_HOT = 100_000, 20_000

_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 other ASCII, 0 part of a longer character
_CLASS[:128] = 3
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def coder_of(ranks: bytes):
    """Encoder of a vocabulary in rank form, one token in base 64 and its rank per line."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoder(path: str):
    """Encoder of a vocabulary file."""
    with open(path, "rb") as f:
        return coder_of(f.read())


def certain_ends(data: np.ndarray) -> np.ndarray:
    """Positions that begin a new word in any context: an ASCII letter or digit before, an ASCII character of another class after.

    Only a run of letters, or of digits, can hold the character before, and it can't go on; what
    follows does not depend on what stands before.
    """
    kind = _CLASS[data]
    return np.flatnonzero(((kind[:-1] == 1) | (kind[:-1] == 2)) & (kind[1:] > 0) & (kind[1:] != kind[:-1])) + 1


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which a cut is proposed: the hash of the last WINDOW bytes ends with CUT_BITS zeros."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    h ^= h >> np.uint32(15)
    factor, width = 0x01000193, 1
    while width < WINDOW:  # the hash of a double width from that of a single one
        h[width:] = h[width:] + h[:-width] * np.uint32(pow(factor, width, 1 << 32))
        width *= 2
    h ^= h >> np.uint32(16)
    return np.flatnonzero((h & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1


def chunk_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Text number, begin, end, and whether the join with the chunk before is uncertain, of all chunks of the texts."""
    proposed, certain = rolling_cuts(data), certain_ends(data)
    ahead = np.append(certain, len(data) + REACH + 1)[np.searchsorted(certain, proposed)]
    sure = ahead - proposed <= REACH
    place = np.where(sure, ahead, proposed)
    no, lo, hi, marked = [], [], [], []
    at = np.searchsorted(proposed, starts, "right")
    to = np.searchsorted(proposed, ends)
    place, sure, raw = place.tolist(), sure.tolist(), proposed.tolist()
    for k, (begin, end, a, b) in enumerate(zip(starts.tolist(), ends.tolist(), at.tolist(), to.tolist())):
        last, open_ = begin, False
        for j in range(a, b):
            p, fine = place[j], sure[j]
            if p >= end:  # the certain end lies in another text
                p, fine = raw[j], False
            if not fine:
                while p < end and data[p] & 0xC0 == 0x80:
                    p += 1
            if p - last >= LEAST and p < end:
                no.append(k), lo.append(last), hi.append(p), marked.append(open_)
                last, open_ = p, not fine
        no.append(k), lo.append(last), hi.append(end), marked.append(open_)
    return no, lo, hi, marked


def _cut(column: pa.Array):
    """Chunks of a batch's texts: memory of all texts, and per chunk the row, begin, end, whether its join is marked, and its number in the row."""
    text = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    body = text.buffers()[2]
    whole = memoryview(body)[: offsets[-1]] if body is not None and offsets[-1] else memoryview(b"")
    no, lo, hi, marked = chunk_bounds(np.frombuffer(whole, np.uint8), offsets[:-1], offsets[1:])
    no = np.array(no)
    first = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
    seq = np.arange(len(no)) - np.repeat(first, np.diff(np.append(first, len(no))))
    return whole, no, np.array(lo), np.array(hi), np.array(marked), seq


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        if not batch.num_rows:
            continue
        whole, no, lo, hi, _, seq = _cut(batch.column("text"))
        h = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(no)), pa.array(seq, pa.int32()), pa.array(h), pa.array(hi - lo)], names=["rid", "seq", "h", "size"])


_PIECE = "kind int, seq int, marked boolean, h long, chunk binary, ids array<int>, encoded long"


def _pieces(ranks):
    """Function for mapInArrow, with the broadcast vocabulary, over rid, key, text, places (seq, h, own).  Kinds of rows: 0 a whole text, 1 a piece of a text that takes chunks
    from elsewhere (ids null where it is taken), 2 a chunk for other places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks.value)
        encode = coder.encode_ordinary
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            row, rest = [], {n: [] for n in ("kind", "seq", "marked", "h", "chunk", "ids", "encoded")}

            def put(k, *values):
                row.append(k)
                for column, v in zip(rest.values(), values):
                    column.append(v)

            shared = [k for k, p in enumerate(places) if p]
            for k, p in enumerate(places):
                if not p:
                    put(k, 0, 0, False, 0, None, encode(texts[k]) if texts[k] else [], len((texts[k] or "").encode()))
            if shared:
                whole, no, lo, hi, marked, seq = _cut(batch.column("text").take(pa.array(shared)))
                starts = np.append(np.flatnonzero(seq == 0), len(no))
                for j, k in enumerate(shared):
                    at = {p["seq"]: p for p in places[k]}
                    got, size = [], 0
                    for c in range(starts[j], starts[j + 1]):
                        chunk, p = bytes(whole[lo[c] : hi[c]]), at.get(int(seq[c]))
                        ids = None
                        if p is None or p["own"]:
                            ids, size = encode(chunk.decode()), size + len(chunk)
                            if p is not None:
                                put(k, 2, 0, False, p["h"], None, ids, 0)
                        keep = marked[c] or c + 1 < starts[j + 1] and marked[c + 1]
                        got.append((bool(marked[c]), chunk if keep else None, ids, p["h"] if ids is None else 0))
                    if all(x[2] is not None for x in got):
                        put(k, 0, 0, False, 0, None, repaired([(m, t, np.array(i, np.int32)) for m, t, i, _ in got], coder), size)
                    else:
                        for c, (m, t, i, h) in enumerate(got):
                            put(k, 1, c, m, h, t, i, size if c == 0 else 0)
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64())
            columns = [pa.array(v, t) for v, t in zip(rest.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), batch.column("key").take(pa.array(row)), *columns], names=["rid", "key", *rest])

    return run


def repaired(pieces: list[tuple[bool, bytes | None, np.ndarray]], coder) -> np.ndarray:
    """Ids of one document from its chunks (marked join before, text if it has a marked join, ids)."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(pieces):
        run = [pieces[k]]
        k += 1
        while k < len(pieces) and pieces[k][0]:
            run.append(pieces[k])
            k += 1
        if len(run) == 1:
            out.append(run[0][2])
            continue
        # where each piece can be parted: (byte, index of the id that starts there), first and last
        tail, sure = b"", None
        for j, (_, text, ids) in enumerate(run):
            sizes = np.cumsum([0, *(len(coder.decode_single_token_bytes(int(i))) for i in ids)])
            ends = certain_ends(np.frombuffer(text, np.uint8))
            at = np.searchsorted(sizes, ends)
            agree = sizes[np.minimum(at, len(sizes) - 1)] == ends
            # ids are only taken over where they end exactly at a certain word end
            spots = [(int(e), int(i)) for e, i in zip(ends[agree], at[agree])]
            head = (0, 0) if j == 0 else spots[0] if spots else None
            last = (len(text), len(ids)) if j == len(run) - 1 else spots[-1] if spots else None
            if head is None:
                tail += text
            else:
                if j:
                    out.append(np.array(coder.encode_ordinary((tail + text[: head[0]]).decode()), ids.dtype))
                    tail = b""
                if last is None:  # only the first piece: nothing to part it by
                    tail = text
                else:
                    out.append(ids[head[1] : last[1]])
                    tail = text[last[0] :]
        if tail:
            out.append(np.array(coder.encode_ordinary(tail.decode()), run[0][2].dtype))
    return np.concatenate(out)


def _assemble(ranks):
    def finish(table: pa.Table) -> pa.RecordBatch:
        coder = coder_of(ranks.value)
        rid = table.column("rid").to_numpy()
        first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
        marked, chunk, ids = (table.column(c).to_pylist() for c in ("marked", "chunk", "ids"))
        parts = [repaired([(marked[i], chunk[i], np.array(ids[i], np.int32)) for i in range(a, b)], coder) for a, b in zip(first, np.append(first[1:], len(rid)))]
        offsets = np.append(0, np.cumsum([len(p) for p in parts]))
        return pa.RecordBatch.from_arrays(
            [table.column("key").combine_chunks().take(pa.array(first)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))], names=["key", "ids"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy()
            begins = int(np.searchsorted(rid, rid[-1]))  # rows are sorted by rid: the last document may go on
            if begins == 0 and (not held or held[-1].column("rid")[0].as_py() == rid[0]):
                held.append(batch)
                continue
            if begins:
                held.append(batch.slice(0, begins))
            yield finish(pa.Table.from_batches(held))
            held = [batch.slice(begins)]
        if held:
            yield finish(pa.Table.from_batches(held))

    return run


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """rid (row number), key, text.  Rows are numbered where they lie, which must not change from one reading to the next; so anything but a plain scan is stored first."""
    data = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    nodes = {line.lstrip(" :+-").split(" ")[0] for line in data._jdf.queryExecution().optimizedPlan().toString().splitlines()}
    if not all(n.startswith(("Project", "Filter", "Relation", "LogicalRDD", "LocalRelation")) for n in nodes if n):
        data = store(data)
    return data.select(F.monotonically_increasing_id().alias("rid"), "key", "text")


def chunk_hashes(rows: DataFrame) -> DataFrame:
    """(rid, seq, h, size) of the content-defined chunks of (rid, text).  Null and empty texts are one empty chunk."""
    return rows.select("rid", "text").mapInArrow(_hashes, "rid long, seq int, h long, size long")


def shared_places(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, seq, h, own) of all places of chunks that stand more than once, own at the first of them; and the hot ones of these chunks (h)."""
    found = store(chunk_hashes(rows).where("size > 0").drop("size"))
    groups = cut_lineage(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "seq")).alias("first")).where("n > 1"))
    least = max(HOT_PLACES, found.count() // MOST_HOT)
    hot = groups.where(F.col("n") >= least)  # at most MOST_HOT rows
    own = ((F.col("first.rid") == F.col("rid")) & (F.col("first.seq") == F.col("seq"))).alias("own")
    places = found.join(groups.where(F.col("n") < least), "h").unionByName(found.join(F.broadcast(hot), "h"))
    return places.select("rid", "seq", "h", own), hot.select("h")


class Encoding:
    """Token ids of a corpus: ``ids`` (key, ids), one row per row of ``df``, and ``encoded`` (one row, n_bytes): the bytes of chunks that went through the encoder.

    Null and empty texts give an empty list, a blank text its usual ids; null and equal keys each keep
    their own row; other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None):
        with open(path or vocabulary(), "rb") as f:  # only the driver needs the file
            ranks = df.sparkSession.sparkContext.broadcast(f.read())
        rows = _rows(df, key, text)
        kind = rows.schema["key"].dataType.simpleString()
        places, hot = shared_places(rows)
        places = cut_lineage(places)
        per = places.groupBy("rid").agg(F.collect_list(F.struct("seq", "h", "own")).alias("places"))  # of one text
        per = F.broadcast(per) if places.count() <= BROADCAST_PLACES else per
        done = rows.join(per, "rid", "left").select("rid", "key", "text", "places").mapInArrow(_pieces(ranks), f"rid long, key {kind}, {_PIECE}")
        done = store(done)
        whole = done.where("kind = 0").select("key", "ids")
        pieces = done.where("kind = 1").select("rid", "key", "seq", "marked", "h", "chunk", "ids")
        given = done.where("kind = 2").select("h", F.col("ids").alias("given"))
        # ids of hot chunks are brought to their places, the others meet by a shuffle
        taken = pieces.where("ids IS NULL").drop("ids")
        hot = F.broadcast(hot)
        filled = taken.join(hot, "h", "left_anti").join(given, "h").unionByName(taken.join(F.broadcast(given.join(hot, "h", "left_semi")), "h"))
        every = pieces.where("ids IS NOT NULL").unionByName(filled.withColumnRenamed("given", "ids")).drop("h")
        back = every.repartition("rid").sortWithinPartitions("rid", "seq").mapInArrow(_assemble(ranks), f"key {kind}, ids array<int>")
        self.ids = whole.unionByName(back).withColumnRenamed("key", key)
        self.encoded = done.agg(F.coalesce(F.sum("encoded"), F.lit(0)).alias("n_bytes"))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``df``: key and the list of token ids of its text, without special tokens (see ``Encoding``)."""
    return Encoding(df, key, text, path).ids


def chunk_reuse(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How much chunks are shared: chunks, distinct chunks, bytes, bytes of distinct chunks."""
    per = chunk_hashes(_rows(df, key, text)).groupBy("h", F.col("size").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("b"), F.lit(0)).alias("distinct_bytes"),
    )
