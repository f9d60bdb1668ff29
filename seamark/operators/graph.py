"""Link graphs: inversion, synchronisation, PageRank, HITS, SALSA, base sets and bounded shortest paths.

A graph is ``nodes`` (id) and distinct ``edges`` (src, dst).  Loops number the nodes once and carry numbers; edges and state are
laid out by number once, so that a round ships only sums per target that each task has made.  There is one lineage cut per round, and the
one before is deleted; sums over all nodes are one-row tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.functions.urls import base_url, link_target
from seamark.session import cut_lineage, forget, keep_layout, lay_out, parallelism, store


def page_graph(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the crawl: distinct ids, and distinct canonical outlinks without null and empty ones."""
    nodes = document.where("id IS NOT NULL").select("id").distinct()
    links = document.where("id IS NOT NULL").select(F.col("id").alias("src"), F.explode("outlinks").alias("link")).where("link <> ''")
    return nodes, links.select("src", link_target(F.col("link")).alias("dst")).distinct()


def from_inlinks(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph derived from inlink lists only: edges turned round, nodes of both ends."""
    links = document.where("id IS NOT NULL").select(F.explode("inlinks").alias("link"), F.col("id").alias("dst")).where("link <> ''")
    edges = links.select(link_target(F.col("link")).alias("src"), "dst").distinct()
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")


def inlinks(edges: DataFrame) -> DataFrame:
    """(id, links): sorted sources of every target."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("links"))


def inlink_blocks(edges: DataFrame, size: int = 10_000) -> DataFrame:
    """(id, block, links): the sorted sources of every target in blocks of about ``size``, so that no page's list outgrows a task."""
    n = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    block = F.pmod(F.xxhash64("src"), F.coalesce(F.ceil(F.col("n") / size), F.lit(1))).cast("int")
    return edges.join(n, "dst", "left").groupBy(F.col("dst").alias("id"), block.alias("block")).agg(F.sort_array(F.collect_set("src")).alias("links"))


def synced_documents(pages: DataFrame, edges: DataFrame, histories: list[DataFrame] = ()) -> DataFrame:
    """Stored pages (id, text, inlinks, outlinks, one row per id) with their links made anew from the graph.

    Inlinks are the crawled pages that link to them, outlinks their targets, those that no history knows collapsed to their host; both
    sorted, empty where there are none.
    """
    nodes = pages.select("id")
    into = inlinks(closed(nodes, edges)).withColumnRenamed("links", "inlinks")
    out = collapse_uncrawled(nodes, edges, histories).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("outlinks"))
    none = F.array().cast("array<string>")
    return pages.select("id", "text").join(into, "id", "left").join(out, "id", "left").select("id", "text", F.coalesce("inlinks", none).alias("inlinks"), F.coalesce("outlinks", none).alias("outlinks"))


def complete(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Adjacency of all nodes, empty where there is none."""
    return nodes.join(adjacency, "id", "left").select("id", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out), 0 where there are none."""
    n_in = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    return nodes.join(n_in, "id", "left").join(n_out, "id", "left").fillna(0, ["n_in", "n_out"])


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without outlinks."""
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def collapse_uncrawled(nodes: DataFrame, edges: DataFrame, histories: list[DataFrame] = ()) -> DataFrame:
    """Edges with every target that no history knows collapsed to its host."""
    known = nodes.select("id")
    for h in histories:
        known = known.union(h.select("id"))
    known = known.distinct().select(F.col("id").alias("dst"), F.lit(True).alias("known"))
    joined = edges.join(known, "dst", "left")
    return joined.select("src", F.when(F.col("known"), F.col("dst")).otherwise(base_url(F.col("dst"))).alias("dst")).distinct()


def verify_inlinks(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages (id, n_stored, n_computed) whose stored inlinks (id, links) differ in number from the graph's; -1 where one side is missing."""
    computed = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_computed"))
    mine = stored.select("id", F.size("links").cast("bigint").alias("n_stored"))
    return mine.join(computed, "id", "full").fillna(-1, ["n_stored", "n_computed"]).where("n_stored <> n_computed")


def numbered(nodes: DataFrame) -> DataFrame:
    """(id, n): the distinct nodes, each with a number."""
    return store(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()))


def _by_number(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Kept edges with numbers for their ends: those from nodes, dst null where it is none."""
    ends = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    return store(edges.join(ends("src"), "src").join(ends("dst"), "dst", "left").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")))


class Ways:
    """Edges laid out by one end; those of very large nodes are left spread and meet the state by a broadcast of its few rows."""

    def __init__(self, edges: DataFrame, end: str):
        self.end = end
        many = cut_lineage(edges.groupBy(end).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1000))
        self.some = not many.isEmpty()
        self.large = many.select(end)
        if self.some:
            fair = edges.count() / parallelism(edges.sparkSession)
            self.large = cut_lineage(many.where(F.col("c") > fair / 2).select(end), many)  # at most 2 per partition
            self.some = not self.large.isEmpty()
        self.near = lay_out(edges.join(F.broadcast(self.large), end, "left_anti") if self.some else edges, end)
        self.spread = cut_lineage(edges.join(F.broadcast(self.large), end, "left_semi")) if self.some else None

    def meet(self, state: DataFrame) -> DataFrame:
        """The edges with the state (a row per node, laid out) of their end."""
        out = self.near.join(state, self.end)
        if not self.some:
            return out
        few = F.broadcast(state.join(F.broadcast(self.large), self.end, "left_semi"))
        return out.unionByName(self.spread.join(few, self.end))

    def forget(self) -> None:
        for df in (self.near, self.spread, self.large):
            if df is not None:
                forget(df)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = 8, damping: float = 0.85, calm: int = 8, most: int = 100, closed_graph: bool = False) -> DataFrame:
    """(id, score) after ``rounds`` rounds, or with None after ``calm`` rounds in total that changed the perplexity by less than 1.

    Out-degrees count all targets, so mass leaks to targets that are no nodes; with ``closed_graph`` only edges between nodes count.
    Sinks share theirs evenly.
    """
    names = numbered(nodes)
    n = names.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    every = _by_number(edges, names)
    inner = every.where("dst IS NOT NULL")
    weight = (inner if closed_graph else every).groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("n_out"))
    ways = Ways(inner, "src")
    state = lay_out(names.select("n").join(weight, "n", "left").select("n", "n_out", F.lit(1.0 / n).alias("score")), "n")
    before, quiet, turn = None, 0, 0
    while turn < (most if rounds is None else rounds):
        lost = F.broadcast(state.agg(F.coalesce(F.sum(F.when(F.col("n_out").isNull(), F.col("score"))), F.lit(0.0)).alias("lost")))  # one row
        flow = ways.meet(state.select(F.col("n").alias("src"), (F.col("score") / F.col("n_out")).alias("part"))).groupBy(F.col("dst").alias("n")).agg(F.sum("part").alias("flow"))
        new = (1 - damping) / n + damping * F.col("lost") / n + damping * F.coalesce("flow", F.lit(0.0))
        state = keep_layout(state.select("n", "n_out").join(flow, "n", "left").crossJoin(lost).select("n", "n_out", new.alias("score")), state)
        turn += 1
        if rounds is None:
            now = perplexity(state).first()["perplexity"]
            quiet += before is not None and abs(now - before) < 1
            before = now
            if quiet >= calm:
                break
    ways.forget()
    return names.join(state, "n").select("id", "score")


def perplexity(scores: DataFrame, strict: bool = True) -> DataFrame:
    """One row: 2 to the entropy of the scores; with ``strict`` 0 if any score is not positive, else such scores are passed over."""
    p = F.col("score")
    value = F.pow(F.lit(2.0), F.coalesce(F.sum(F.when(p > 0, -p * F.log2(p))), F.lit(0.0)))
    return scores.agg(F.when(F.coalesce(F.min(p), F.lit(0.0)) <= 0, 0.0).otherwise(value).alias("perplexity") if strict else value.alias("perplexity"))


def _length(scores: DataFrame, of: str) -> DataFrame:
    """One row: the length of a column as a vector."""
    return F.broadcast(scores.agg(F.sqrt(F.sum(F.col(of) * F.col(of))).alias("length")))


def hits(base: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, authority, hub), both of length 1, over the edges within ``base``; 0 everywhere if nothing links.

    Lengths don't change directions, so a round goes from hubs to authorities to hubs, and hubs are brought to length 1 before the next.
    """
    names = numbered(base)
    inner = _by_number(edges, names).where("dst IS NOT NULL")
    by_src, by_dst = Ways(inner, "src"), Ways(inner, "dst")
    state = lay_out(names.select("n", F.lit(0.0).alias("authority"), F.lit(1.0).alias("hub")), "n")
    scale = F.lit(1.0)
    for turn in range(rounds):
        hub = state.select(F.col("n").alias("src"), "hub")
        if turn:
            scale = F.when(F.col("length") > 0, 1 / F.col("length")).otherwise(0.0)
            hub = hub.crossJoin(_length(state, "hub"))
        authority = by_src.meet(hub.select("src", (F.col("hub") * scale).alias("hub"))).groupBy("dst").agg(F.sum("hub").alias("authority"))
        new = by_dst.meet(authority).groupBy("src").agg(F.sum("authority").alias("hub"))
        both = state.select("n").join(authority.withColumnRenamed("dst", "n"), "n", "left").join(new.withColumnRenamed("src", "n"), "n", "left")
        state = keep_layout(both.fillna(0.0, ["authority", "hub"]), state)
    by_src.forget()
    by_dst.forget()
    unit = lambda c: F.when(F.col(f"{c}_length") > 0, F.col(c) / F.col(f"{c}_length")).otherwise(0.0).alias(c)
    lengths = F.broadcast(state.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"{c}_length") for c in ("authority", "hub")]))  # one row
    return names.join(state, "n").crossJoin(lengths).select("id", unit("authority"), unit("hub"))


def salsa(base: DataFrame, edges: DataFrame, kind: str = "hub", rounds: int | None = None) -> DataFrame:
    """(id, score) of SALSA hubs (3 rounds) or authorities (5 rounds) of ``base``, degrees over the whole graph.

    The two hops of a round are two sums, so no pair of pages is ever formed.  A page that receives nothing
    keeps its score.
    """
    if kind not in ("hub", "authority"):
        raise ValueError("kind is hub or authority")
    own, far = ("src", "dst") if kind == "hub" else ("dst", "src")
    rounds = rounds or (3 if kind == "hub" else 5)
    names = numbered(base)
    both = store(edges.select(F.col(own).alias("own"), F.col(far).alias("far")))
    far_names = store(both.groupBy("far").agg(F.count(F.lit(1)).alias("far_deg")).withColumn("f", F.monotonically_increasing_id()))
    ways = store(both.join(names.select(F.col("id").alias("own"), "n"), "own").join(far_names, "far").select("n", "f", "far_deg"))
    by_own, by_far = Ways(ways.select("n", "f"), "n"), Ways(ways, "f")
    deg = ways.groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    state = names.select("n").join(deg, "n", "left")
    begun = F.broadcast(deg.agg(F.count(F.lit(1)).alias("begun")))
    state = lay_out(state.crossJoin(begun).select("n", "deg", F.when(F.col("deg").isNotNull(), 1.0 / F.col("begun")).otherwise(0.0).alias("score")), "n")
    for _ in range(rounds):
        out = by_own.meet(state.where("deg IS NOT NULL").select("n", (F.col("score") / F.col("deg")).alias("x"))).groupBy("f").agg(F.sum("x").alias("t"))
        new = by_far.meet(out).groupBy("n").agg(F.sum(F.col("t") / F.col("far_deg")).alias("z"))
        state = keep_layout(state.join(new, "n", "left").select("n", "deg", F.coalesce("z", "score").alias("score")), state)
    by_own.forget()
    by_far.forget()
    return names.join(state, "n").select("id", "score")


def expand_base(roots: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 200, order: str = "id") -> DataFrame:
    """Roots, their crawled targets, and their crawled sources: all, or ``most`` + 1 of them where there are more than ``most``.

    Those are the first by ``id``, or with ``order`` hash an even sample, the same each time.
    """
    if order not in ("id", "hash"):
        raise ValueError("order is id or hash")
    inner = closed(nodes, edges)
    out = inner.join(roots.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = inner.join(roots.withColumnRenamed("id", "dst"), "dst", "left_semi")
    by = [F.xxhash64("src", "dst"), F.col("src")] if order == "hash" else [F.col("src")]
    some = into.withColumn("n", F.row_number().over(W.partitionBy("dst").orderBy(*by))).where(F.col("n") <= most + 1).select(F.col("src").alias("id"))
    return roots.select("id").union(out).union(some).distinct()


def top_scores(nodes: DataFrame, edges: DataFrame, scores: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` best scores with both degrees, ties by id."""
    return scores.orderBy(F.desc("score"), "id").limit(k).join(degrees(nodes, edges), "id")


def bounded_path(edges: DataFrame, source: int, target: int, stops: list[int], most_stops: int, most_hops: int) -> DataFrame:
    """Cheapest way (dist, hops, stops) from source to target with bounded hops and visits to ``stops``; no row if there is none.

    ``edges`` is (u, v, w), w = 0 is no edge, negative weights are allowed.  A layer is the least cost per vertex
    and number of visits after a number of hops.  Ties: fewer visits, then fewer hops.
    """
    spark = edges.sparkSession
    ways = cut_lineage(edges.where("w <> 0").select("u", "v", "w", F.col("v").isin(*stops).cast("int").alias("stop")))
    layer = spark.createDataFrame([(source, int(source in stops), 0)], "v int, stops int, dist long")
    ends = []
    for hop in range(1, most_hops + 1):
        step = layer.withColumnRenamed("v", "u").join(ways, "u").select("v", (F.col("stops") + F.col("stop")).alias("stops"), (F.col("dist") + F.col("w")).alias("dist"))
        layer = cut_lineage(step.where(F.col("stops") <= most_stops).groupBy("v", "stops").agg(F.min("dist").alias("dist")))
        ends.append(layer.where(F.col("v") == target).select("dist", F.lit(hop).alias("hops"), "stops"))
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    return every.orderBy("dist", "stops", "hops").limit(1)
