"""Main body of web pages: which lines of a page's text belong to the site's frame.

The page's HTML goes through streaming parser events into blocks and a text-to-tag ratio per block line;
smoothing and threshold clustering choose the content region (see ``pageblocks``), and the lines of the text
take the verdict of the block they come from.  Boxes inside the region that the page alone does not decide are
frame if their shape recurs beside different bodies.  Lines that no HTML speaks for (it is missing or cut off)
are judged by the shape of lines in pages whose HTML is whole: counts over all of them tell which
shapes are frame and which of those open a box of entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.llm.pageblocks import content_blocks, parse
from seamark.llm.words import blocks
from seamark.session import cut_lineage

#: Bytes of text in one block of pages.
BLOCK_BYTES = 1 << 20
#: A shape is frame if at least this share of its lines are, and opens a box if this share of them are followed by an entry.
FRAME_SHARE, OPENER_SHARE = 0.9, 0.6
#: Boxes inside content regions are frame if their shape stands beside so many different bodies.
RECURS = 3
#: Shapes that stand on most lines are broadcast, so many of them (32 bytes each); the others are joined by a shuffle.
COMMON = 50_000

_CAPITAL = re.compile(r"(?<=\s)[^\W\d_a-zß-öø-ÿ][\w'’-]*(?: [^\W\d_a-zß-öø-ÿ][\w'’-]*)*")
_REPEAT = re.compile(r"( ?[^\w\s]* ?X)(?:\1)+")
_BOX = re.compile(r"^([^:;]{2,40}):.*;")
_SENTENCE = re.compile(r"[.!?…][\"'”»)\]]*$")


def shape(line: str) -> str:
    """A line without its names and numbers: capitalised words behind the first are X, digits 0, repeats once."""
    box = _BOX.match(line)
    if box:
        return box[1].lower() + ": ;"
    out = _CAPITAL.sub("X", re.sub(r"\d+", "0", line))
    return _REPEAT.sub(r"\1", out).lower()


def is_sentence(line: str) -> bool:
    """At least six words and an end mark."""
    return line.count(" ") >= 5 and bool(_SENTENCE.search(line))


def is_entry(line: str) -> bool:
    """Looks like an entry of a box: a bullet or a small letter first, and no sentence."""
    return bool(line) and (line[0] in "*-•–·" or line[0].islower()) and not is_sentence(line)


def judge(text: str, html: str | None) -> tuple[int, list[int], list[tuple], list[tuple], str]:
    """Quality (2 whole HTML, 1 cut off, 0 none), frame lines, undecided lines (line, shape, sentence, entry, behind content), lessons (shape, frame, opener) and the page's longest line of content.

    Lines of boxes that their page leaves undecided give lessons without a verdict.
    """
    lines = [" ".join(x.split()) for x in text.split("\n")]
    if not html:
        return 0, [], [(k, shape(x), is_sentence(x), is_entry(x), False) for k, x in enumerate(lines, 1) if x], [], ""
    page = parse(html)
    good, region = content_blocks(page)
    said: dict[str, list[bool | None]] = {}
    longest = ""
    for k, (block, content) in enumerate(zip(page.blocks, good)):
        if content and len(block[1]) > len(longest):
            longest = block[1]
        for part in {block[1], *page.split.get(k, ())}:
            said.setdefault(part, []).append(content)
    over = bool(region) and region[-1] in page.closed
    verdict: list[bool | None] = []
    boxed: set[int] = set()  # lines of undecided boxes
    for k, x in enumerate(lines):
        votes = said.get(x) if x else None
        # a line that stands in both is taken in the order of the page
        verdict.append(None if not votes else votes.pop(0) if len(votes) > 1 else votes[0])
        if votes and verdict[-1] is None:
            boxed.add(k)
    filled = [k for k, x in enumerate(lines) if x]
    if not page.cut:
        # whole HTML has every frame line; what is not found in it is part of a content block
        lessons = []
        for a, b in zip(filled, [*filled[1:], -1]):
            entry = b >= 0 and verdict[a] is False and verdict[b] is False and is_entry(lines[b])
            lessons.append((shape(lines[a]), None if a in boxed else verdict[a] is False, entry))
        undecided = [(k + 1, shape(lines[k]), False, False, False) for k in sorted(boxed)]
        return 2, [k + 1 for k in filled if verdict[k] is False], undecided, lessons, longest
    frame, undecided = [], []
    last = max((k for k in filled if verdict[k]), default=-1)
    behind = False  # content since the last undecided line
    for k in filled:
        if verdict[k] is False or verdict[k] is None and over and k > last:
            frame.append(k + 1)
        elif verdict[k] is None:
            undecided.append((k + 1, shape(lines[k]), is_sentence(lines[k]), is_entry(lines[k]), behind))
            behind = False
        else:
            behind = True
    return 1, frame, undecided, [], longest


_KINDS = "quality int, frame array<int>, undecided array<struct<line:int,shape:long,sentence:boolean,entry:boolean,behind:boolean>>, lessons array<struct<shape:long,frame:boolean,opener:boolean>>, longest long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def h(x: str) -> int:
        v = xxhash.xxh3_64_intdigest(x)
        return v - (1 << 64) if v >> 63 else v

    undecided = pa.list_(pa.struct([("line", pa.int32()), ("shape", pa.int64()), ("sentence", pa.bool_()), ("entry", pa.bool_()), ("behind", pa.bool_())]))
    lessons = pa.list_(pa.struct([("shape", pa.int64()), ("frame", pa.bool_()), ("opener", pa.bool_())]))
    for block in blocks(batches, "text", BLOCK_BYTES):
        q, f, u, s, m = [], [], [], [], []
        for text, html in zip(block.column("text").to_pylist(), block.column("html").to_pylist()):
            quality, frame, open_, learnt, longest = judge(text, html)
            q.append(quality)
            f.append(frame)
            u.append([{"line": k, "shape": h(x), "sentence": b, "entry": c, "behind": e} for k, x, b, c, e in open_])
            s.append([{"shape": h(x), "frame": a, "opener": b} for x, a, b in learnt])
            m.append(h(longest))
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), pa.array(q, pa.int32()), pa.array(f, pa.list_(pa.int32())), pa.array(u, undecided), pa.array(s, lessons), pa.array(m, pa.int64())],
            names=["id", "quality", "frame", "undecided", "lessons", "longest"],
        )


def learnt_shapes(judged: DataFrame) -> DataFrame:
    """(shape, n, share, opens) of the shapes that are frame: their lines, the share of these that are, and of those that open a box.

    Lines of undecided boxes are frame if boxes of pages with RECURS different bodies have their shape: an article's own
    list goes with its body, wherever that is copied to, and a prompt stands in any.
    """
    rows = judged.select("longest", F.explode("lessons").alias("x"))
    rows = rows.select("x.shape", F.when(F.col("x.frame").isNull(), F.col("longest")).alias("body"), F.col("x.frame").cast("int").alias("frame"), F.col("x.opener").cast("int").alias("opener"))
    # a shape that stands on very many pages is counted per body first
    per = rows.groupBy("shape", "body").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("frame"), F.lit(0)).alias("frames"), F.sum("opener").alias("openers"))
    boxed = F.col("body").isNotNull()
    s = per.groupBy("shape").agg(
        F.sum("n").alias("n"), F.sum("frames").alias("frames"), F.sum("openers").alias("openers"), F.coalesce(F.sum(F.when(boxed, F.col("n"))), F.lit(0)).alias("boxed"), F.count("body").alias("bodies")
    )
    share = (F.col("frames") + F.when(F.col("bodies") >= RECURS, F.col("boxed")).otherwise(0)) / F.col("n")
    return s.select("shape", "n", share.alias("share"), (F.col("openers") / F.col("n")).alias("opens")).where(F.col("share") >= FRAME_SHARE)


def _with_shapes(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Lines with share and opens of their shape, null where it is none of ``shapes``.  A prompt that very many lines show makes no task of its own."""
    known = shapes.select("shape", "share", "opens")
    common = F.broadcast(shapes.orderBy(F.desc("n"), "shape").limit(COMMON).select("shape", "share", "opens"))
    first = lines.join(common, "shape", "left")
    return first.where("share IS NOT NULL").unionByName(first.where("share IS NULL").drop("share", "opens").join(known, "shape", "left"))


def frame_lines(pages: DataFrame, id: str = "id", text: str = "text", html: str = "raw_html") -> DataFrame:
    """Distinct (id, line_no) of the frame lines of each page's text, lines counted from 1 at every newline.

    Rows with a null id or text and blank lines give nothing.  Where a page has several rows, those with
    the best HTML decide.  Without any whole HTML in the table, undecided lines are body.
    """
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{html}`").alias("html")).where("id IS NOT NULL AND text <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    judged = cut_lineage(rows.mapInArrow(_judge, f"id {kind}, {_KINDS}").withColumn("rid", F.monotonically_increasing_id()))
    best = judged.groupBy("id").agg(F.max("quality").alias("quality"))
    # whole pages decide for themselves, but for the boxes they leave open; only the others need the comparison
    whole = judged.where("quality = 2")
    sure = whole.select("id", F.explode("frame").alias("line_no"))
    rest = judged.where("quality < 2").join(best, ["id", "quality"], "left_semi")
    shapes = cut_lineage(learnt_shapes(judged))
    boxes = whole.select("id", F.explode("undecided").alias("u")).select("id", "u.line", "u.shape")
    boxes = _with_shapes(boxes, shapes).where("share IS NOT NULL").select("id", F.col("line").alias("line_no"))
    lines = rest.select("id", "rid", F.explode("undecided").alias("u")).select("id", "rid", "u.line", "u.shape", "u.sentence", "u.entry", "u.behind")
    known = _with_shapes(lines, shapes)
    # the last line before that is no entry itself tells whether a box is open; content in between closes it
    known = known.withColumn("run", F.sum(F.col("behind").cast("int")).over(W.partitionBy("rid").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("rid", "run").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("opens") >= OPENER_SHARE, F.lit(True)).when(F.col("share").isNotNull() & ~F.col("entry"), F.lit(False)).when(F.col("sentence"), F.lit(False))
    verdict = F.col("share").isNotNull() | (~F.col("sentence") & F.coalesce(F.last(F.col("mark"), ignorenulls=True).over(before), F.lit(False)))
    found = known.withColumn("mark", mark).withColumn("frame", verdict).where("frame").select("id", F.col("line").alias("line_no"))
    every = sure.unionByName(boxes).unionByName(rest.select("id", F.explode("frame").alias("line_no"))).unionByName(found)
    return every.distinct()


def main_text(pages: DataFrame, id: str = "id", text: str = "text", html: str = "raw_html") -> DataFrame:
    """One row per page (id) with a text: id and its main body, the lines that are no frame, joined by newlines.

    Blank lines are left out.  Of several texts of one id the smallest is taken; a page that is all frame has an empty body.
    """
    one = pages.where(F.col(id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(text).alias("text"))
    frame = frame_lines(pages, id, text, html).groupBy("id").agg(F.collect_set("line_no").alias("frame"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: (F.trim(x) != "") & ~F.coalesce(F.array_contains("frame", i + 1), F.lit(False)))
    return one.join(frame, "id", "left").select("id", F.array_join(kept, "\n").alias("body"))
