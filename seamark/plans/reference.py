"""Queries of the search pipeline (text, index, retrieval, urls, graph, evaluation) over the test tables, and their SQL.

Loops are unrolled for the SQL by small string builders; scores are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seamark.functions import html as H
from seamark.functions import urls as U
from seamark.operators import crawl as C
from seamark.operators import evaluate as E
from seamark.operators import graph as G
from seamark.operators import index as I
from seamark.operators import search as S
from seamark.plans.porter_sql import stems
from seamark.session import cut_lineage, shared_folder, store
from seamark.sources import trec as T
from seamark.sources.tables import table

TOPIC = ["trawler", "harbour", "sank"]
#: Stop list of the registered queries; longer ones are read from files (``read_words``).
STOPS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
COUNTRIES = ["Norway", "South Korea", "Estonia", "Italy", "Ship News"]
_INDEXES: dict[tuple[str, str, str], I.Index] = {}


def _index(s, d, of: str = "documents") -> I.Index:
    """Index of the documents, or of the pages, of a folder: built by the first query that searches it, and used by all others of the program."""
    at = (s.sparkContext.applicationId, d, of)
    if at not in _INDEXES:
        docs, key = (table(s, d, of), "doc_id") if of == "documents" else (_pages(s, d).select("id", "text"), "id")
        _INDEXES[at] = I.build_index(docs, shared_folder(s), key, stop=tuple(STOPS))
    return _INDEXES[at]


def _roots(s, d) -> DataFrame:
    return S.root_set(_index(s, d, "pages"), TOPIC)


def _round(df: DataFrame, *cols: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _graph(s, d):
    return G.page_graph(table(s, d, "document"))


def _trade(s, d):
    """A larger graph: customers and suppliers by order lines, with some ways back."""
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, p = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    back = lines.where("l_returnflag = 'R' AND l_suppkey % 3 <> 0").select(p.alias("src"), c.alias("dst"))
    edges = store(lines.select(c.alias("src"), p.alias("dst")).union(back).distinct())
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def _pages(s, d) -> DataFrame:
    """One row per page: the last fetched."""
    return I.last_wins(table(s, d, "document"), "id", "fetched_at", "batch_no")


def _qrels(s, d) -> DataFrame:
    q = table(s, d, "combined_qrel")
    panel = lambda n: F.col("assessor_id").isNotNull() & (F.pmod(F.length("assessor_id"), F.lit(3)) == n)
    return E.merge_assessors(*(E.panel_grades(q, panel(n)) for n in (0, 1, 2)))


def _judged(s, d) -> tuple[DataFrame, DataFrame]:
    return E.best_run(table(s, d, "result_bm25")), E.binarise(_qrels(s, d))


def _links(s, d) -> DataFrame:
    return table(s, d, "document").where("id IS NOT NULL").select("id", F.explode("outlinks").alias("link")).where("link <> ''").distinct()


def _rules(s, d) -> DataFrame:
    """Robots rules of every host: the status of its pages and a flag by the length of its name."""
    base = U.base_url(F.col("id")).alias("base_url")
    rows = table(s, d, "document").where("id IS NOT NULL").select(base, "http_status")
    return rows.groupBy("base_url").agg(F.min("http_status").alias("status"), (F.pmod(F.length("base_url"), F.lit(5)) > 0).alias("allowed"))


def _crawl(s, d) -> DataFrame:
    """Crawl to the end of the reference.  Stored pages can be read unless their last row says 404 or 410; seeds are known but not stored, so their links are in the inlinks."""
    doc, seeds = table(s, d, "document"), table(s, d, "crawl_seed")
    links = _graph(s, d)[1].union(G.from_inlinks(doc)[1])
    last = I.last_wins(doc.select("id", "fetched_at", "batch_no", "http_status"), "id", "fetched_at", "batch_no")
    there = last.where("http_status IS NULL OR http_status NOT IN (404, 410)").select("id").union(seeds.select("url"))
    return C.crawl(links, seeds, None, 1000, pages=there, robots=_rules(s, d))


def _crawl_stored(s, d) -> DataFrame:
    """Crawl from the HTML of stored pages; the pages that seeds are said to link to are the entry here."""
    pages, seeds = _pages(s, d), table(s, d, "crawl_seed")
    entry = G.from_inlinks(table(s, d, "document"))[1].join(seeds.withColumnRenamed("url", "src"), "src").groupBy(F.col("dst").alias("url")).agg(F.max("score").alias("score"), F.min("wave").alias("wave"))
    return C.crawl_stored(pages, entry, 1000, _rules(s, d))


def _upserted(s, d, keep_if_empty: bool = False) -> DataFrame:
    """First fetch of every page, merged with its last."""
    doc = table(s, d, "document").where("id IS NOT NULL")
    pick = lambda o: doc.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(*o))).where("n = 1").select("id", "text", "inlinks", "outlinks")
    time = [F.col(c) for c in ("batch_no", "fetched_at", "http_status")]
    out = I.upsert(pick([c.asc_nulls_first() for c in time]).where("size(inlinks) > 0 OR text IS NOT NULL"), pick([c.desc_nulls_last() for c in time]), keep_if_empty)
    return out.select("id", F.length("text").alias("n_chars"), F.size("inlinks").alias("n_in"), F.size("outlinks").alias("n_out"), "action")


def _weighted(s, d) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("u"))
    a = n.select("u", ((F.col("u") * 7 + 3) % 25).alias("v"), (F.col("u") % 5 + 1).alias("w"))
    b = n.select("u", ((F.col("u") * 11 + 4) % 25).alias("v"), (F.col("u") * 3 % 7 - 1).alias("w"))
    return a.union(b).where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def _synced(s, d) -> DataFrame:
    out = G.synced_documents(_pages(s, d), _graph(s, d)[1], [table(s, d, "crawl_seed").select(F.col("url").alias("id"))])
    return out.select("id", F.length("text").alias("n_chars"), F.array_join("inlinks", " ").alias("inlinks"), F.array_join("outlinks", " ").alias("outlinks"))


def _link_scores(s, d) -> DataFrame:
    """Score of every link between crawled pages; the parent's score is its relevance, countries are penalised."""
    doc = table(s, d, "document").where("id IS NOT NULL")
    keys = U.url_keywords(F.col("id"))
    known = doc.groupBy("id").agg(F.min("wave").alias("wave"), (U.url_relevance(keys) - U.country_penalty(keys, COUNTRIES)).alias("relevance"))
    edges = G.closed(*_graph(s, d)).join(known.select(F.col("id").alias("src"), "wave", F.col("relevance").alias("parent")), "src").join(known.select(F.col("id").alias("dst"), "relevance"), "dst")
    return edges.select("src", "dst", U.link_score(F.col("relevance"), F.col("parent"), F.col("wave") + 1).alias("score"))


def _top_hits(s, d, kind: str) -> DataFrame:
    """Top 500 of the HITS scores of a topic's base set."""
    base = cut_lineage(G.expand_base(_roots(s, d), *_graph(s, d)))
    return G.top_scores(*_graph(s, d), _round(G.hits(base, _graph(s, d)[1]).select("id", F.col(kind).alias("score")), "score"))


_STOPS, _SOURCE, _TARGET, _MOST_STOPS, _HOPS = [1, 4, 7, 10, 13, 16, 19, 22], 0, 18, 2, 8


def queries() -> dict:
    doc = lambda s, d: table(s, d, "documents")
    page = lambda s, d: table(s, d, "document")
    asked = lambda s, d: table(s, d, "queries")
    ids = lambda df: df.where("id IS NOT NULL").select("id").distinct()
    return {
        # text and index
        "tokens_postings": lambda s, d: I.postings(doc(s, d)),
        "term_stats": lambda s, d: I.term_stats(I.postings(doc(s, d))),
        "doc_lengths": lambda s, d: I.doc_lengths(doc(s, d)),
        "corpus_stats": lambda s, d: _round(I.corpus_stats(I.doc_lengths(doc(s, d))), "avg_len", places=6),
        "stemmed_postings": lambda s, d: I.postings(doc(s, d), stop=STOPS, stem=True),
        "stop_then_stem_postings": lambda s, d: I.postings(doc(s, d), stop=STOPS, stem=True, stop_first=True),
        "index_terms": lambda s, d: _index(s, d).terms,
        "refine_queries": lambda s, d: S.analyzed_queries(asked(s, d), STOPS),
        # retrieval
        "bm25_topk": lambda s, d: _round(S.bm25(_index(s, d), asked(s, d)), "score", places=6).select("query_id", "doc_id", "score"),
        "default_similarity_topk": lambda s, d: _round(S.default_similarity(_index(s, d), asked(s, d)), "score", places=6).select("query_id", "doc_id", "score"),
        "query_string_page": lambda s, d: S.page_of_hits(_index(s, d), asked(s, d), 201, 220).select("query_id", "doc_id"),
        "term_lookup": lambda s, d: S.term_lookup(_index(s, d), "trawler"),
        "match_all_scan": lambda s, d: S.match_all(doc(s, d), "doc_id", "source", "n_chars"),
        "root_set": lambda s, d: _roots(s, d),
        "run_lines": lambda s, d: T.run_lines(E.best_run(table(s, d, "result_bm25")).withColumn("score", F.col("score").cast("decimal(18,6)"))),
        "trec_doc_format": lambda s, d: T.trec_documents(doc(s, d), "doc_id", "source", "text", "wave"),
        # urls and pages
        "base_url": lambda s, d: _links(s, d).select("link", U.base_url(F.col("link")).alias("base")).distinct(),
        "canonical_url": lambda s, d: _links(s, d).select("id", "link", U.canonical_url(F.col("link"), F.col("id")).alias("target")),
        "doc_key": lambda s, d: ids(page(s, d)).select("id", U.doc_key(F.col("id")).alias("doc_key")),
        "useful_links": lambda s, d: _links(s, d).where(U.useful_link(F.col("link"))).select("link").distinct(),
        "url_keywords": lambda s, d: ids(page(s, d)).select("id", F.array_join(U.url_keywords(F.col("id")), " ").alias("keywords")),
        "url_relevance": lambda s, d: ids(page(s, d)).select("id", U.url_relevance(U.url_keywords(F.col("id"))).alias("relevance")),
        "frontier_score": _link_scores,
        "extract_title": lambda s, d: page(s, d).where("raw_html IS NOT NULL").select("id", H.title(F.col("raw_html")).alias("title")).distinct(),
        "extract_links": lambda s, d: H.page_links(page(s, d)),
        "page_type_filter": lambda s, d: page(s, d).where(H.is_page(F.col("headers"))).groupBy("headers").agg(F.count(F.lit(1)).alias("n")),
        "body_text": lambda s, d: H.extract_text(page(s, d)),
        "robots_filter": lambda s, d: C.robots_allowed(ids(page(s, d)), _rules(s, d)),
        "merge_partitions": lambda s, d: I.last_wins(page(s, d).select("id", "batch_no", "http_status"), "id", "batch_no"),
        "upsert_documents": _upserted,
        "upsert_keep_empty": lambda s, d: _upserted(s, d, True),
        # graph
        "invert_edges": lambda s, d: G.inlinks(_graph(s, d)[1]).select("id", F.size("links").alias("n"), F.array_join("links", " ").alias("links")),
        "complete_missing": lambda s, d: G.complete(_graph(s, d)[0], G.inlinks(_graph(s, d)[1])).select("id", F.size("links").alias("n")),
        "degrees": lambda s, d: G.degrees(*_graph(s, d)),
        "sinks": lambda s, d: G.sinks(*_graph(s, d)),
        "crawled_inlinks": lambda s, d: G.inlinks(G.closed(*_graph(s, d))).select("id", F.array_join("links", " ").alias("links")),
        "outlinks_from_inlinks": lambda s, d: G.from_inlinks(page(s, d))[1],
        "domain_collapse": lambda s, d: G.collapse_uncrawled(*_graph(s, d), [table(s, d, "crawl_seed").select(F.col("url").alias("id"))]),
        "synced_documents": _synced,
        "inlink_blocks": lambda s, d: G.inlink_blocks(_graph(s, d)[1], 20).groupBy("id").agg(F.sum(F.size("links")).alias("n"), F.array_join(F.sort_array(F.flatten(F.collect_list("links"))), " ").alias("links")),
        "verify_inlinks": lambda s, d: G.verify_inlinks(_pages(s, d).select("id", F.array_distinct(F.coalesce("inlinks", F.array().cast("array<string>"))).alias("links")), G.closed(*_graph(s, d))),
        "pagerank_8": lambda s, d: _round(G.pagerank(*_graph(s, d), rounds=8), "score", places=10),
        "pagerank_8_trade": lambda s, d: _round(G.pagerank(*_trade(s, d), rounds=8), "score", places=10),
        "hits_10_trade": lambda s, d: _round(G.hits(*_trade(s, d)), "authority", "hub"),
        "salsa_hub_3_trade": lambda s, d: _round(G.salsa(*_trade(s, d), "hub"), "score"),
        "pagerank_closed": lambda s, d: _round(G.pagerank(*_graph(s, d), rounds=4, closed_graph=True), "score", places=10),
        "perplexity_lenient": lambda s, d: _round(G.perplexity(G.pagerank(*_graph(s, d), rounds=2).select((F.col("score") - 0.0005).alias("score")), strict=False), "perplexity", places=4),
        "perplexity": lambda s, d: _round(G.perplexity(G.pagerank(*_graph(s, d), rounds=8)), "perplexity", places=4),
        "top500": lambda s, d: _round(G.top_scores(*_graph(s, d), G.degrees(*_graph(s, d)).select("id", F.col("n_in").cast("double").alias("score"))), "score"),
        "top500_pagerank": lambda s, d: G.top_scores(*_graph(s, d), _round(G.pagerank(*_graph(s, d), rounds=None), "score", places=10)),
        "top500_authorities": lambda s, d: _top_hits(s, d, "authority"),
        "top500_hubs": lambda s, d: _top_hits(s, d, "hub"),
        "expand_base": lambda s, d: G.expand_base(_roots(s, d), *_graph(s, d)),
        "hits_10": lambda s, d: _round(G.hits(*_graph(s, d)), "authority", "hub"),
        "salsa_hub_3": lambda s, d: _round(G.salsa(*_graph(s, d), "hub"), "score"),
        "salsa_auth_5": lambda s, d: _round(G.salsa(*_graph(s, d), "authority"), "score"),
        "bounded_path": lambda s, d: G.bounded_path(_weighted(s, d), _SOURCE, _TARGET, _STOPS, _MOST_STOPS, _HOPS),
        "frontier_simulation": _crawl,
        "crawl_stored_pages": _crawl_stored,
        # evaluation
        "merge_assessors": _qrels,
        "precision_recall_f1_at_k": lambda s, d: _round(E.at_cutoffs(*_judged(s, d)), "precision", "recall", "f1"),
        "cutoffs_compat": lambda s, d: _round(E.at_cutoffs(*_judged(s, d), total=20, compat=True), "precision", "recall", "f1"),
        "average_precision": lambda s, d: _round(E.average_precision(*_judged(s, d)), "ap"),
        "r_precision": lambda s, d: _round(E.r_precision(*_judged(s, d)), "r_precision"),
        "interpolated_pr": lambda s, d: _round(E.interpolated(*_judged(s, d)), "precision"),
        "ndcg": lambda s, d: _round(E.ndcg(*_judged(s, d)), "ndcg"),
        "eval_summary": lambda s, d: _round(E.summary(*_judged(s, d)), "map", "r_precision", "ndcg", places=6),
        "eval_report": lambda s, d: _round(E.report(*_judged(s, d)), "value", places=6),
        "ndcg_all_judged": lambda s, d: _round(E.ndcg(*_judged(s, d), ideal="qrels"), "ndcg"),
        "eval_means_at_k": lambda s, d: _round(E.means_at_cutoffs(*_judged(s, d)), "precision", "recall", "f1", places=6),
        "pr_curve": lambda s, d: _round(E.pr_curve(*_judged(s, d)), "precision", places=6),
    }


# ---- SQL ----

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


_POSTS = f"posts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY doc_id, term)"
_LENS = f"lens AS MATERIALIZED (SELECT doc_id, coalesce(len({_TOKENS.format('text')}), 0)::BIGINT AS len FROM documents)"
_STOP = "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"
# words, and stems, that query refinement drops
_REFINE_WORDS = """('any','anticipate','air','actual','area','application','basis','cite','current','contrast','controversy','discuss','document','Document','directly','describe','develop',
    'event','exist','group','include','identify','instances','location','level','least','method','make','motivation','one','predict','prediction','product','pending','perpetrated','platform',
    'report','role','result','solely','second','some','system','side','specific','success','since','something','support','study','taken','type','water','will','worldwide')"""
_REFINE_STEMS = """('side','action','actual','ha','studi','system','someth','motiv','perpetr','ongo','measur','specifi','unsubstanti','product','level','contrast','standard','make','preliminari','exist','take','')"""
_QTOK = rf"""qtok AS MATERIALIZED (SELECT query_id, unnest({_TOKENS.format("array_to_string(list_filter(string_split(translate(text, ',' || chr(34), ''), ' '), lambda w: w NOT IN " + _REFINE_WORDS + "), ' ')")}) AS term
    FROM queries WHERE query_id IS NOT NULL)"""
_DTOK = f"dtok AS MATERIALIZED (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)"
_QTERMS = f"qterms AS MATERIALIZED (SELECT query_id, stem AS term, count(*) AS qtf FROM qtok JOIN stems USING (term) WHERE stem NOT IN {_STOP} AND stem NOT IN {_REFINE_STEMS} GROUP BY query_id, stem)"
_SPOSTS = f"sposts AS MATERIALIZED (SELECT doc_id, stem AS term, count(*) AS tf FROM dtok JOIN stems USING (term) WHERE stem NOT IN {_STOP} GROUP BY doc_id, stem)"
_STEMMED = f"{_DTOK}, {_QTOK}, atok AS (SELECT term FROM dtok UNION ALL SELECT term FROM qtok), {stems('atok')}, {_SPOSTS}, {_QTERMS}"
_BM25 = "qtf * ln((n + 0.5) / (df + 0.5)) * ((tf + 1.2 * tf) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) * ((qtf + 100.0 * qtf) / (qtf + 100.0))"
_DEFAULT = "qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


def _ranked(weight: str) -> str:
    return f"""WITH {_STEMMED}, slens AS (SELECT doc_id, sum(tf) AS len FROM sposts GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM sposts) / (SELECT count(*) FROM documents) AS avg_len),
    ts AS (SELECT term, count(*) AS df FROM sposts GROUP BY term),
    sc AS (SELECT query_id, doc_id, sum({weight}) AS score FROM sposts JOIN ts USING (term) JOIN qterms USING (term) JOIN slens USING (doc_id), st GROUP BY query_id, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


_PAGES = """pages AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, batch_no DESC NULLS LAST) AS nth
    FROM document WHERE id IS NOT NULL) WHERE nth = 1)"""
_CANON = r"""CASE WHEN regexp_matches({0}, '^(?i)https?://') THEN 'http://' || regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?]*)', 1)), ':(80|443)$', '')
    || regexp_replace({0}, '^[a-zA-Z]+://[^/?]*', '') ELSE {0} END"""
_BARE = "split_part(link, '#', 1)"
_GRAPH = f"""nodes AS MATERIALIZED (SELECT DISTINCT id FROM document WHERE id IS NOT NULL),
    edges AS MATERIALIZED (SELECT DISTINCT id AS src, {_CANON.format(_BARE)} AS dst FROM (SELECT id, unnest(outlinks) AS link FROM document WHERE id IS NOT NULL) WHERE link <> '')"""
_TRADE = """lines AS MATERIALIZED (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS p, l_returnflag = 'R' AND l_suppkey % 3 <> 0 AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    edges AS MATERIALIZED (SELECT c AS src, p AS dst FROM lines UNION SELECT p, c FROM lines WHERE back), nodes AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""
_CLOSED = "closed AS MATERIALIZED (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"
_LINKS = "links AS MATERIALIZED (SELECT DISTINCT id, link FROM (SELECT id, unnest(outlinks) AS link FROM document WHERE id IS NOT NULL) WHERE link <> '')"
_BASE = r"regexp_extract({0}, '^([a-zA-Z][^:/?#]*)://', 1) || '://' || regexp_extract({0}, '^[a-zA-Z][^:/?#]*://([^/?#]*)', 1)"
_ROOT = rf"""ptok AS MATERIALIZED (SELECT id, unnest({_TOKENS.format('text')}) AS term FROM pages), {stems('ptok')},
    rall AS MATERIALIZED (SELECT id, stem AS term, count(*) AS tf FROM ptok JOIN stems USING (term) WHERE stem NOT IN {_STOP} GROUP BY id, stem),
    rposts AS (SELECT * FROM rall WHERE term IN ('trawler', 'harbour', 'sank')), rlens AS (SELECT id, sum(tf) AS len FROM rall GROUP BY id),
    rst AS (SELECT (SELECT count(*) FROM pages) AS n, (SELECT sum(tf) FROM rall) / (SELECT count(*) FROM pages) AS avg_len),
    rts AS (SELECT term, count(*) AS df, 1 AS qtf FROM rposts GROUP BY term),
    roots AS MATERIALIZED (SELECT id FROM (SELECT id, sum({_DEFAULT}) AS score FROM rposts JOIN rts USING (term) JOIN rlens USING (id), rst GROUP BY id) ORDER BY round(score, 9) DESC, id LIMIT 1000)"""


def _pagerank_sql(rounds: int = 8) -> str:
    out = [f"WITH {_GRAPH}, outd AS (SELECT src, count(*) AS n_out FROM edges GROUP BY src), total AS (SELECT count(*) AS n FROM nodes), pr0 AS (SELECT id, 1.0::DOUBLE / n AS score FROM nodes, total)"]
    for i in range(rounds):
        out.append(f"""l{i} AS MATERIALIZED (SELECT coalesce(sum(score), 0) AS lost FROM pr{i} WHERE id NOT IN (SELECT src FROM outd)),
            f{i} AS MATERIALIZED (SELECT dst AS id, sum(score / n_out) AS flow FROM edges JOIN pr{i} ON src = id JOIN outd USING (src) GROUP BY dst),
            pr{i + 1} AS MATERIALIZED (SELECT nodes.id, 0.15::DOUBLE / n + 0.85::DOUBLE * lost / n + 0.85::DOUBLE * coalesce(flow, 0) AS score FROM nodes LEFT JOIN f{i} USING (id), total, l{i})""")
    return ", ".join(out)


def _hits_ctes(rounds: int = 10, before: str = "") -> list[str]:
    out = [f"WITH {before}{_GRAPH if not before else ''}{', ' if not before else ''}{_CLOSED}, h0 AS (SELECT id, 1.0::DOUBLE AS hub FROM nodes)"]
    for i in range(rounds):
        out.append(f"""x{i} AS MATERIALIZED (SELECT nodes.id, coalesce(x, 0) AS x FROM nodes LEFT JOIN (SELECT dst AS id, sum(hub) AS x FROM closed JOIN h{i} ON src = id GROUP BY dst) USING (id)),
            a{i + 1} AS MATERIALIZED (SELECT id, coalesce(x / nullif((SELECT sqrt(sum(x * x)) FROM x{i}), 0), 0) AS authority FROM x{i}),
            y{i} AS MATERIALIZED (SELECT nodes.id, coalesce(x, 0) AS x FROM nodes LEFT JOIN (SELECT src AS id, sum(authority) AS x FROM closed JOIN a{i + 1} ON dst = id GROUP BY src) USING (id)),
            h{i + 1} AS MATERIALIZED (SELECT id, coalesce(x / nullif((SELECT sqrt(sum(x * x)) FROM y{i}), 0), 0) AS hub FROM y{i})""")
    return out


def _hits_sql(rounds: int = 10) -> str:
    return ", ".join(_hits_ctes(rounds)) + f" SELECT id, round(authority, 8) AS authority, round(hub, 8) AS hub FROM a{rounds} JOIN h{rounds} USING (id)"


def _top_sql(kind: str) -> str:
    """Top 500 of HITS scores over the base set of a topic: the base takes the place of the nodes."""
    graph = _GRAPH.replace("nodes AS", "allnodes AS")
    base = f"""{_PAGES}, {_ROOT}, {graph}, inner_ AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM allnodes) AND dst IN (SELECT id FROM allnodes)),
        i AS (SELECT src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM inner_ WHERE dst IN (SELECT id FROM roots)),
        nodes AS MATERIALIZED (SELECT id FROM roots UNION SELECT dst FROM inner_ WHERE src IN (SELECT id FROM roots) UNION SELECT src FROM i WHERE n <= 201), """
    best = f"(SELECT id, round({kind}, 8) AS score FROM {kind[0]}10)"
    return ", ".join(_hits_ctes(10, base)) + f", {_DEGREES} SELECT id, score, n_in, n_out FROM {best} JOIN dg USING (id) ORDER BY score DESC, id LIMIT 500"


_DEGREES = "dg AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS n_in, (SELECT count(*) FROM edges WHERE src = id) AS n_out FROM (SELECT DISTINCT id FROM document WHERE id IS NOT NULL))"


def _settled_sql(most: int = 60) -> str:
    """PageRank that ends with the eighth round in total that changed the perplexity by less than 1."""
    px = " UNION ALL ".join(f"SELECT {i} AS turn, CASE WHEN min(score) <= 0 THEN 0 ELSE pow(2, sum(-score * log2(score))) END AS p FROM pr{i}" for i in range(1, most + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS turn, id, score FROM pr{i}" for i in range(1, most + 1))
    return f"""{_pagerank_sql(most)}, px AS ({px}), calm AS (SELECT turn, sum((abs(p - before) < 1)::INT) OVER (ORDER BY turn) AS quiet FROM (SELECT *, lag(p) OVER (ORDER BY turn) AS before FROM px)),
        last AS (SELECT min(turn) AS turn FROM calm WHERE quiet >= 8), {_DEGREES}
        SELECT id, round(score, 10) AS score, n_in, n_out FROM ({every}) JOIN last USING (turn) JOIN dg USING (id) ORDER BY round(score, 10) DESC, id LIMIT 500"""


def _salsa_sql(own: str, far: str, rounds: int) -> str:
    out = [f"""WITH {_GRAPH}, dg AS MATERIALIZED (SELECT {own} AS id, count(*) AS deg FROM edges GROUP BY {own}), fd AS MATERIALIZED (SELECT {far} AS far, count(*) AS far_deg FROM edges GROUP BY {far}),
        s0 AS MATERIALIZED (SELECT id, deg, CASE WHEN deg IS NULL THEN 0 ELSE 1.0::DOUBLE / (SELECT count(*) FROM nodes JOIN dg USING (id)) END AS score FROM nodes LEFT JOIN dg USING (id))"""]
    for i in range(rounds):
        out.append(f"""t{i} AS MATERIALIZED (SELECT {far} AS far, sum(score / deg) AS t FROM edges JOIN s{i} ON {own} = id WHERE deg IS NOT NULL GROUP BY {far}),
            z{i} AS MATERIALIZED (SELECT {own} AS id, sum(t / far_deg) AS z FROM edges JOIN t{i} ON {far} = t{i}.far JOIN fd ON fd.far = t{i}.far GROUP BY {own}),
            s{i + 1} AS MATERIALIZED (SELECT id, deg, coalesce(z, score) AS score FROM s{i} LEFT JOIN z{i} USING (id))""")
    return ", ".join(out) + f" SELECT id, round(score, 8) AS score FROM s{rounds}"


def _path_sql() -> str:
    stops = "(" + ", ".join(map(str, _STOPS)) + ")"
    out = [f"""WITH e AS MATERIALIZED (SELECT u, v, min(w) AS w FROM (SELECT n_nationkey AS u, (n_nationkey * 7 + 3) % 25 AS v, n_nationkey % 5 + 1 AS w FROM nation
        UNION ALL SELECT n_nationkey, (n_nationkey * 11 + 4) % 25, n_nationkey * 3 % 7 - 1 FROM nation) WHERE u <> v GROUP BY u, v),
        ways AS MATERIALIZED (SELECT u, v, w, (v IN {stops})::INT AS stop FROM e WHERE w <> 0), p0 AS (SELECT {_SOURCE} AS v, {int(_SOURCE in _STOPS)} AS stops, 0::BIGINT AS dist)"""]
    for i in range(_HOPS):
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT ways.v, stops + stop AS stops, min(dist + w) AS dist FROM p{i} JOIN ways ON p{i}.v = u WHERE stops + stop <= {_MOST_STOPS} GROUP BY 1, 2)")
    ends = " UNION ALL ".join(f"SELECT dist, {i} AS hops, stops FROM p{i} WHERE v = {_TARGET}" for i in range(1, _HOPS + 1))
    return ", ".join(out) + f" SELECT dist::BIGINT AS dist, hops::INT AS hops, stops::INT AS stops FROM ({ends}) ORDER BY dist, stops, hops LIMIT 1"


_PANEL = "(SELECT query_id, doc_id, max(grade) AS grade FROM combined_qrel WHERE grade IN (0, 1, 2) AND query_id IS NOT NULL AND doc_id IS NOT NULL AND length(assessor_id) % 3 = {} GROUP BY query_id, doc_id)"
_MERGED = f"""merged AS MATERIALIZED (SELECT a.query_id, a.doc_id, CASE WHEN b.grade IS NULL THEN greatest(a.grade, c.grade) WHEN a.grade = b.grade THEN a.grade
    WHEN c.grade IS NULL THEN greatest(a.grade, b.grade) WHEN a.grade = c.grade THEN a.grade ELSE greatest(a.grade, b.grade, c.grade) END AS grade
    FROM {_PANEL.format(0)} a LEFT JOIN {_PANEL.format(1)} b USING (query_id, doc_id) LEFT JOIN {_PANEL.format(2)} c USING (query_id, doc_id))"""
_RUN = """run AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(grade) AS score FROM result_bm25
    WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL AND NOT isnan(grade) GROUP BY query_id, doc_id))"""
_JUDGED = f"""WITH {_MERGED}, {_RUN}, rel AS (SELECT query_id, count(*) AS n_rel FROM merged WHERE grade > 0 GROUP BY query_id),
    g AS (SELECT run.query_id, run.doc_id, rank, n_rel, coalesce(CASE WHEN grade = 2 THEN 1 ELSE grade END, 0) AS grade FROM run LEFT JOIN merged ON run.query_id = merged.query_id AND run.doc_id = merged.doc_id JOIN rel ON rel.query_id = run.query_id),
    h AS (SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM g),
    j AS MATERIALIZED (SELECT *, hits / rank AS precision, hits / n_rel AS recall FROM h)"""
_AP = "ap AS (SELECT query_id, sum(grade * precision) / max(n_rel) AS ap FROM j GROUP BY query_id)"
_RP = "rp AS (SELECT query_id, coalesce(max(hits) FILTER (rank <= n_rel), 0) / max(n_rel) AS r_precision FROM j GROUP BY query_id)"
_ND = """i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM j),
    nd AS (SELECT query_id, coalesce(sum(CASE WHEN rank = 1 THEN grade ELSE grade / log2(rank) END) / nullif(sum(CASE WHEN ideal = 1 THEN grade ELSE grade / log2(ideal) END), 0), 0) AS ndcg FROM i GROUP BY query_id)"""
_IP = """b AS (SELECT *, max(precision) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM j),
    lv AS (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS recall_level),
    ip AS (SELECT query_id, recall_level, coalesce(min_by(best, rank) FILTER (recall >= recall_level), 0) AS precision FROM b, lv GROUP BY query_id, recall_level)"""
_FOLDER = r"regexp_replace(regexp_replace(id, '[?#].*$', ''), '(://[^/]*/(?:.*/)?)[^/]*$', '\1')"
_WHOLE = rf"""CASE WHEN starts_with(bare, '../') THEN {_FOLDER} || substr(bare, 4) WHEN starts_with(bare, '//') THEN regexp_extract(id, '^([^/]*)//', 1) || bare
    WHEN starts_with(bare, '/') THEN {_BASE.format('id')} || bare ELSE bare END"""
_CANONICAL = rf"""lower(substr(whole, 1, length({_BASE.format('whole')}))) || substr(whole, length({_BASE.format('whole')}) + 1)"""


def _dots(url: str) -> str:
    """A url without parts of its path that are dots."""
    head, path = rf"regexp_extract({url}, '^([a-zA-Z][^:/?#]*://[^/?#]*)', 1)", rf"regexp_extract({url}, '^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)', 1)"
    step = "CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END"
    clean = f"list_reduce(list_prepend('', string_split({path}, '/')[2:]), lambda done, x: {step})"
    return rf"""CASE WHEN regexp_matches({path}, '/\.\.?(/|$)') THEN {head} || CASE WHEN {clean} = '' THEN '/' ELSE {clean} END
        || CASE WHEN regexp_matches({path}, '/\.\.?$') AND {clean} <> '' AND NOT ends_with({clean}, '/') THEN '/' ELSE '' END || regexp_extract({url}, '([?#].*)$', 1) ELSE {url} END"""


_HREF = r"""replace(replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')), '&quot;', '"'), '&#34;', '"'), '&#39;', chr(39)), '&apos;', chr(39)),
    '&lt;', '<'), '&gt;', '>'), '&#38;', '&'), '&amp;', '&')"""


def _stripped(link: str) -> str:
    return f"split_part(replace(replace(replace({link}, ':80', ''), ':443', ''), 'https', 'http'), '#', 1)"


_NAME = r"""CASE WHEN path LIKE '%Category:%' THEN regexp_extract(path, 'Category:(.*)$', 1)
    WHEN path IN ('', '/') THEN coalesce(string_split(regexp_extract(id, '^[a-zA-Z][^:/?#]*://([^/?#]*)', 1), '.')[2], '')
    WHEN path LIKE '%/' THEN split_part(string_split(path, '/')[-2], '.', 1) ELSE split_part(translate(string_split(path, '/')[-1], '()''', ''), '.', 1) END"""
_KEYS = rf"""keys AS (SELECT id, list_filter(CASE WHEN contains(name, '_') THEN head || string_split(name, '_') WHEN contains(name, '-') THEN head || string_split(name, '-') ELSE [name] END, lambda w: w <> '') AS k
    FROM (SELECT id, {_NAME} AS name, CASE WHEN path LIKE '%Category:%' THEN ['Category'] ELSE []::VARCHAR[] END AS head
    FROM (SELECT DISTINCT id, regexp_extract(id, '^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)', 1) AS path FROM document WHERE id IS NOT NULL)))"""
# fixed values, written out for themselves so that they can check the engine's
_SEA = """('uss','hms','rms','ms','titan','titanic','armada','submarin','ship','warship','boat','maritim','marin','cruis','vessel','seoul','shipwreck','wreckag','wreck','sink','sunk','lifeboat',
    'submerg','fog','rocki','sewol','mv','naval','fleet','navy','liner','starship','battleship','passeng','voyag','sea','nautic','fisherman','distress',
    'dona','paz','black','swan','white','vasa','queen','mary','rose','arizona','lusitania','sultana','republic','rms','titanic','ss','kiangya','seawise','giant','eastland','wilhelm','gustloff','rhone')"""
_BAD = """('earthquak','fatal','accid','disast','death','rescu','survivor','rediscov','excav','tragedi','tragic','unidentifi','recov','helicopt','doom','collid','overturn','inquiri','catastroph','danger','lost','save')"""
_LAND = """('aviat','airbu','boe','takeoff','aviat','jet','engin','land','airlin','aerial','pilot','airplan','airway','malfunct','runway','aeroplan','plane','aircraft','airport','turbul','cockpit','debri','crash','explos',
    'rail','railway','train','line','railroad','tram','electr','derail','wagon','coach')"""
_RELEVANCE = rf"""rel AS (SELECT id, 1.0::DOUBLE + len(list_filter(k, lambda w: w IN {_SEA})) - len(list_filter(k, lambda w: w NOT IN {_SEA} AND w IN {_LAND}))
    + CASE WHEN len(list_filter(k, lambda w: w IN {_SEA})) > 0 THEN 1.5 * len(list_filter(k, lambda w: w IN {_BAD}))
      + CASE WHEN len(list_filter(k, lambda w: w IN {_BAD})) > 0 AND lower(k[1]) IN ('category', 'list') THEN 2 ELSE 0 END ELSE 0 END AS relevance FROM keys)"""
_USEFUL = (
    r"^(?:http://en\.wikipedia\.org/w/index\.php|http://en\.wikipedia\.org/wiki/Main_Page|.+wiki/Help|http://www\.cruiselinefans.+|.*facebook.*|.*wikimedia.*|.+share.+|.+/shop.*|.+license.*|.+/blog.*|.+/copyright.*|"
    r"http://en\.wikipedia\.org/wiki/Wikipedia:|.*mediawiki.*|.*language.*|.+/wiki.+Template:.+|.+/wiki/Special:.+|.+wiki/Portal:.+|.+wiki/Talk:.+|.+wiki.+talk:.+|.*donate.*|.*music.*|.*login.*|.*food.*|.*garden.*|"
    r".*defence-news.*|.*exhibitions.*|.*privacy.*|.*finance.*|.*sport.*|.*horoscope.*|.*entertainment.*|.*user.*|.*advertise.*|.*watsapp.*|.*book.*|.*/science/.*|.*celebrity.*|.*/travel/.*|.*style.*|.*corona.*|"
    r".*art.*|.*literature.*|.*religion.*|.*law.*|.*politics.*|http://en\.m|http://www\.yonhapnews\.co\.kr|http://www\.ytn\.co\.kr/|.*\.jpg$|.*\.JPG$|.*\.svg$|.*\.asp$|.*\.png$)"
)


_THERE = """SELECT id FROM (SELECT id, http_status, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, batch_no DESC NULLS LAST, http_status DESC NULLS LAST) AS nth
    FROM document WHERE id IS NOT NULL) WHERE nth = 1 AND coalesce(http_status NOT IN (404, 410), true) UNION SELECT url FROM crawl_seed"""
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""


def _crawl_sql(rounds: int = 6, stored: bool = False) -> str:
    """The crawl, unrolled; rounds after the frontier is empty add nothing (it takes 3 at sf0.01)."""
    keys = _KEYS.replace("FROM document WHERE id IS NOT NULL", "FROM (SELECT id FROM document WHERE id IS NOT NULL UNION SELECT url FROM crawl_seed)")

    def raised(score: str, n_in: str, new: str) -> str:
        times = f"greatest(0, least({new}, 9 - {n_in}))"
        return f"CASE WHEN {times} > 0 THEN round(round({score} + 0.0125::DOUBLE, 2) + ({times} - 1) * 0.01::DOUBLE, 2) ELSE {score} END"

    hrefs = f"""SELECT DISTINCT id AS src, {_CANONICAL} AS dst FROM (SELECT *, {_dots('joined')} AS whole FROM (SELECT *, {_WHOLE} AS joined FROM (SELECT id, {_stripped('link')} AS bare FROM (
        SELECT id, {_HREF} AS link FROM (SELECT id, unnest(regexp_extract_all(raw_html, '{_ANCHOR}', 1)) AS raw FROM live)) WHERE link <> '' AND NOT starts_with(link, '#')))) WHERE whole <> ''"""
    wave = "coalesce(z.wave, f.pw + 1)"
    fresh = f"round((0.4::DOUBLE * relevance + 0.3::DOUBLE * f.ps + 0.35::DOUBLE / {wave})::DECIMAL(18, 6), 2)::DOUBLE"
    out = [f"""WITH {keys}, {_RELEVANCE}, {_PAGES}, {_GRAPH}, inl AS (SELECT DISTINCT {_CANON.format(_BARE)} AS src, id AS dst FROM (SELECT id, unnest(inlinks) AS link FROM document WHERE id IS NOT NULL) WHERE link <> ''),
        rb AS (SELECT base, CASE WHEN status IN (401, 403) THEN false WHEN status >= 400 THEN true ELSE length(base) % 5 > 0 END AS ok FROM (
            SELECT base, min(http_status) AS status FROM (SELECT http_status, {_BASE.format('id')} AS base FROM document WHERE id IS NOT NULL) GROUP BY base)),
        live AS MATERIALIZED (SELECT id, raw_html FROM pages WHERE raw_html IS NOT NULL AND headers IN ('text/html', 'text/html; charset=UTF-8', 'text/html; charset=utf-8', 'text/html;charset=utf-8')),
        begin_ AS MATERIALIZED (SELECT dst AS url, max(score) AS score, min(wave) AS wave FROM inl JOIN crawl_seed ON url = src GROUP BY dst),
        there AS ({"SELECT id FROM live" if stored else _THERE}),
        okp AS MATERIALIZED (SELECT id FROM (SELECT id, {_BASE.format('id')} AS base FROM there) LEFT JOIN rb USING (base) WHERE coalesce(ok, true)),
        lk AS MATERIALIZED (SELECT src, dst FROM ({hrefs if stored else "SELECT src, dst FROM edges UNION SELECT src, dst FROM inl"}) WHERE regexp_matches(dst, '^http://(www|en)') AND NOT regexp_matches(dst, '{_USEFUL}')
            AND src IN (SELECT id FROM okp) AND dst IN (SELECT id FROM okp)),
        z0 AS (SELECT url, max(score) AS score, min(wave) AS wave, 0::BIGINT AS n_in, NULL::INT AS turn FROM {"begin_" if stored else "crawl_seed"} WHERE url IN (SELECT id FROM okp) GROUP BY url)"""]
    for i in range(1, rounds + 1):
        out.append(f"""t{i} AS MATERIALIZED (SELECT url, score, wave FROM z{i - 1} WHERE turn IS NULL ORDER BY score DESC, url LIMIT 1000),
            f{i} AS MATERIALIZED (SELECT dst AS url, first(score ORDER BY score DESC, src) AS ps, first(wave ORDER BY score DESC, src) AS pw, count(*) AS n FROM lk JOIN t{i} ON url = src GROUP BY dst),
            y{i} AS (SELECT url, score, wave, n_in, coalesce(turn, CASE WHEN url IN (SELECT url FROM t{i}) THEN {i} END) AS turn FROM z{i - 1}),
            z{i} AS MATERIALIZED (SELECT coalesce(z.url, f.url) AS url, CASE WHEN z.score IS NULL THEN {raised(fresh, "1", "n - 1")} WHEN z.turn IS NULL AND n IS NOT NULL THEN {raised("z.score", "z.n_in", "n")} ELSE z.score END AS score,
                {wave} AS wave, coalesce(z.n_in, 0) + coalesce(n, 0) AS n_in, z.turn FROM y{i} z FULL JOIN f{i} f ON z.url = f.url LEFT JOIN rel ON rel.id = coalesce(z.url, f.url))""")
    return ", ".join(out) + f" SELECT url, score, wave::INT AS wave, turn::INT AS turn FROM z{rounds} WHERE turn IS NOT NULL"


def _first_last(order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no {order}, fetched_at {order}, http_status {order}) AS nth FROM document WHERE id IS NOT NULL) WHERE nth = 1)"


def oracle_sql() -> dict[str, str]:
    nn = "list_filter(coalesce({}, []), lambda x: x IS NOT NULL)"
    return {
        "tokens_postings": f"WITH {_POSTS} SELECT doc_id, term, tf FROM posts",
        "term_stats": f"WITH {_POSTS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM posts GROUP BY term",
        "doc_lengths": f"WITH {_LENS} SELECT doc_id, len FROM lens",
        "corpus_stats": f"WITH {_LENS} SELECT count(*) AS n_docs, sum(len)::BIGINT AS total_len, round(avg(len), 6) AS avg_len FROM lens",
        "stemmed_postings": f"WITH {_STEMMED} SELECT doc_id, term, tf FROM sposts",
        "stop_then_stem_postings": f"WITH {_DTOK}, {stems('dtok')} SELECT doc_id, stem AS term, count(*) AS tf FROM dtok JOIN stems USING (term) WHERE term NOT IN {_STOP} GROUP BY doc_id, stem",
        "index_terms": f"WITH {_STEMMED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM sposts GROUP BY term",
        "refine_queries": f"WITH {_STEMMED} SELECT query_id, term, qtf FROM qterms",
        "bm25_topk": f"{_ranked(_BM25)} SELECT query_id, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 200",
        "default_similarity_topk": f"{_ranked(_DEFAULT)} SELECT query_id, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 200",
        "query_string_page": f"{_ranked(_DEFAULT)} SELECT query_id, doc_id FROM rk WHERE rank BETWEEN 201 AND 220",
        "term_lookup": f"WITH {_STEMMED} SELECT doc_id, term, tf FROM sposts WHERE term = 'trawler'",
        "match_all_scan": "SELECT doc_id, source, n_chars FROM documents",
        "root_set": f"WITH {_PAGES}, {_ROOT} SELECT id FROM roots",
        "run_lines": f"WITH {_RUN} SELECT query_id || ' ' || doc_id || ' ' || rank || ' ' || score::DECIMAL(18,6) AS value FROM run",
        "trec_doc_format": r"""SELECT wave, E'<DOC>\n<DOCNO>' || doc_id || E'</DOCNO>\n<HEAD>' || coalesce(source, '') || E'</HEAD>\n<TEXT>\n' || coalesce(text, '') || E'\n</TEXT>\n</DOC>\n' AS value FROM documents""",
        "base_url": f"WITH {_LINKS} SELECT DISTINCT link, {_BASE.format('link')} AS base FROM links",
        "canonical_url": f"WITH {_LINKS} SELECT id, link, {_CANONICAL} AS target FROM (SELECT *, {_dots('joined')} AS whole FROM (SELECT *, {_WHOLE} AS joined FROM (SELECT *, {_stripped('link')} AS bare FROM links)))",
        "doc_key": "SELECT DISTINCT id, replace(replace(id, '://', '-'), '/', '-') AS doc_key FROM document WHERE id IS NOT NULL",
        "useful_links": f"WITH {_LINKS} SELECT DISTINCT link FROM links WHERE regexp_matches(link, '^http://(www|en)') AND NOT regexp_matches(link, '{_USEFUL}')",
        "url_keywords": f"WITH {_KEYS} SELECT id, array_to_string(k, ' ') AS keywords FROM keys",
        "url_relevance": f"WITH {_KEYS}, {_RELEVANCE} SELECT id, relevance FROM rel",
        "frontier_score": f"""WITH {_KEYS}, {_RELEVANCE}, {_GRAPH}, {_CLOSED},
            pen AS (SELECT id, relevance - (len(k) BETWEEN 1 AND 2 AND lower(array_to_string(k, ' ')) IN ('norway', 'south korea', 'estonia', 'italy', 'ship news'))::INT AS r FROM rel JOIN keys USING (id)),
            wv AS (SELECT id, min(wave) AS wave FROM document GROUP BY id)
            SELECT src, dst, round((0.4::DOUBLE * d.r + 0.3::DOUBLE * s.r + 0.35::DOUBLE / (wave + 1))::DECIMAL(18, 6), 2)::DOUBLE AS score
            FROM closed JOIN pen s ON s.id = src JOIN pen d ON d.id = dst JOIN wv ON wv.id = src""",
        "extract_title": "SELECT DISTINCT id, regexp_extract(raw_html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM document WHERE raw_html IS NOT NULL",
        "extract_links": rf"""SELECT DISTINCT id, {_CANONICAL} AS target FROM (SELECT *, {_dots('joined')} AS whole FROM (SELECT *, {_WHOLE} AS joined FROM (SELECT id, {_stripped('link')} AS bare FROM (
            SELECT id, {_HREF} AS link FROM (SELECT id, unnest(regexp_extract_all(raw_html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)) AS raw FROM document)) WHERE link <> '' AND NOT starts_with(link, '#')))) WHERE whole <> ''""",
        "page_type_filter": f"SELECT headers, count(*) AS n FROM document WHERE headers IN ('text/html', 'text/html; charset=UTF-8', 'text/html; charset=utf-8', 'text/html;charset=utf-8') GROUP BY headers",
        "robots_filter": f"""WITH d AS (SELECT id, http_status, {_BASE.format('id')} AS base FROM document WHERE id IS NOT NULL),
            r AS (SELECT base, min(http_status) AS status, length(base) % 5 > 0 AS allowed FROM d GROUP BY base)
            SELECT DISTINCT id FROM d JOIN r USING (base) WHERE CASE WHEN status IN (401, 403) THEN false WHEN status >= 400 THEN true ELSE allowed END""",
        "merge_partitions": "SELECT id, batch_no, max(http_status) AS http_status FROM document JOIN (SELECT id, max(batch_no) AS batch_no FROM document GROUP BY id) USING (id, batch_no) GROUP BY id, batch_no",
        "upsert_documents": f"""WITH o AS (SELECT id, text, {nn.format('inlinks')} AS inlinks, {nn.format('outlinks')} AS outlinks FROM {_first_last('ASC NULLS FIRST')} WHERE len(inlinks) > 0 OR text IS NOT NULL),
            n AS (SELECT id, text, {nn.format('inlinks')} AS inlinks, {nn.format('outlinks')} AS outlinks FROM {_first_last('DESC NULLS LAST')}),
            b AS (SELECT n.id, o.text AS ot, n.text AS nt, o.inlinks AS oi, n.inlinks AS ni, o.outlinks AS oo, n.outlinks AS no, list_distinct(o.inlinks || n.inlinks) AS un, o.id IS NULL AS fresh FROM n LEFT JOIN o USING (id)),
            a AS (SELECT *, CASE WHEN fresh THEN 'insert' WHEN len(un) > len(list_distinct(oi)) THEN 'update' ELSE 'keep' END AS action FROM b)
            SELECT id, length(CASE WHEN action = 'keep' THEN ot ELSE nt END)::INT AS n_chars, len(CASE action WHEN 'insert' THEN ni WHEN 'update' THEN un ELSE oi END)::INT AS n_in,
            len(CASE WHEN action = 'keep' THEN oo ELSE no END)::INT AS n_out, action FROM a""",
        "upsert_keep_empty": f"""WITH o AS (SELECT id, text, {nn.format('inlinks')} AS inlinks, {nn.format('outlinks')} AS outlinks FROM {_first_last('ASC NULLS FIRST')} WHERE len(inlinks) > 0 OR text IS NOT NULL),
            n AS (SELECT id, text, {nn.format('inlinks')} AS inlinks, {nn.format('outlinks')} AS outlinks FROM {_first_last('DESC NULLS LAST')}),
            b AS (SELECT n.id, o.text AS ot, n.text AS nt, o.inlinks AS oi, n.inlinks AS ni, o.outlinks AS oo, n.outlinks AS no, list_distinct(o.inlinks || n.inlinks) AS un, o.id IS NULL AS fresh FROM n LEFT JOIN o USING (id)),
            a AS (SELECT *, CASE WHEN fresh THEN 'insert' WHEN len(un) > len(list_distinct(oi)) AND len(oi) > 0 THEN 'update' ELSE 'keep' END AS action FROM b)
            SELECT id, length(CASE WHEN action = 'keep' THEN ot ELSE nt END)::INT AS n_chars, len(CASE action WHEN 'insert' THEN ni WHEN 'update' THEN un ELSE oi END)::INT AS n_in,
            len(CASE WHEN action = 'keep' THEN oo ELSE no END)::INT AS n_out, action FROM a""",
        "invert_edges": f"WITH {_GRAPH} SELECT dst AS id, count(*)::INT AS n, string_agg(src, ' ' ORDER BY src) AS links FROM edges GROUP BY dst",
        "complete_missing": f"WITH {_GRAPH} SELECT id, coalesce(n, 0)::INT AS n FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) USING (id)",
        "degrees": f"WITH {_GRAPH} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS n_in, (SELECT count(*) FROM edges WHERE src = id) AS n_out FROM nodes",
        "sinks": f"WITH {_GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)",
        "crawled_inlinks": f"WITH {_GRAPH}, {_CLOSED} SELECT dst AS id, string_agg(src, ' ' ORDER BY src) AS links FROM closed GROUP BY dst",
        "outlinks_from_inlinks": f"SELECT DISTINCT {_CANON.format(_BARE)} AS src, id AS dst FROM (SELECT id, unnest(inlinks) AS link FROM document WHERE id IS NOT NULL) WHERE link <> ''",
        "domain_collapse": f"WITH {_GRAPH} SELECT DISTINCT src, CASE WHEN dst IN (SELECT id FROM nodes UNION SELECT url FROM crawl_seed) THEN dst ELSE {_BASE.format('dst')} END AS dst FROM edges",
        "synced_documents": f"""WITH {_PAGES}, {_GRAPH}, {_CLOSED}, i AS (SELECT dst AS id, string_agg(src, ' ' ORDER BY src) AS inlinks FROM closed GROUP BY dst),
            c AS (SELECT DISTINCT src, CASE WHEN dst IN (SELECT id FROM nodes UNION SELECT url FROM crawl_seed) THEN dst ELSE {_BASE.format('dst')} END AS dst FROM edges),
            o AS (SELECT src AS id, string_agg(dst, ' ' ORDER BY dst) AS outlinks FROM c GROUP BY src)
            SELECT id, length(text)::INT AS n_chars, coalesce(i.inlinks, '') AS inlinks, coalesce(o.outlinks, '') AS outlinks FROM pages LEFT JOIN i USING (id) LEFT JOIN o USING (id)""",
        "inlink_blocks": f"WITH {_GRAPH} SELECT dst AS id, count(*) AS n, string_agg(src, ' ' ORDER BY src) AS links FROM edges GROUP BY dst",
        "verify_inlinks": f"""WITH {_GRAPH}, {_CLOSED}, {_PAGES}, m AS (SELECT id, len(list_distinct(coalesce(inlinks, []))) + (list_contains(list_transform(coalesce(inlinks, []), lambda x: x IS NULL), true))::INT AS n FROM pages),
            c AS (SELECT dst AS id, count(*) AS k FROM closed GROUP BY dst)
            SELECT id, coalesce(n, -1)::BIGINT AS n_stored, coalesce(k, -1)::BIGINT AS n_computed FROM m FULL JOIN c USING (id) WHERE coalesce(n, -1) <> coalesce(k, -1)""",
        "pagerank_8_trade": _pagerank_sql().replace(_GRAPH, _TRADE) + " SELECT id, round(score, 10) AS score FROM pr8",
        "hits_10_trade": _hits_sql().replace(_GRAPH, _TRADE),
        "salsa_hub_3_trade": _salsa_sql("src", "dst", 3).replace(_GRAPH, _TRADE),
        "top500_pagerank": _settled_sql(),
        "top500_authorities": _top_sql("authority"),
        "top500_hubs": _top_sql("hub"),
        "pagerank_closed": _pagerank_sql(4).replace("edges AS MATERIALIZED", "every AS MATERIALIZED").replace(", outd AS", ", edges AS MATERIALIZED (SELECT src, dst FROM every WHERE dst IN (SELECT id FROM nodes)), outd AS") + " SELECT id, round(score, 10) AS score FROM pr4",
        "perplexity_lenient": f"{_pagerank_sql(2)} SELECT round(pow(2, coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0)), 4) AS perplexity FROM (SELECT score - 0.0005::DOUBLE AS p FROM pr2)",
        "pagerank_8": f"{_pagerank_sql()} SELECT id, round(score, 10) AS score FROM pr8",
        "perplexity": f"{_pagerank_sql()} SELECT CASE WHEN min(score) <= 0 THEN 0 ELSE round(pow(2, sum(-score * log2(score))), 4) END AS perplexity FROM pr8",
        "top500": f"""WITH {_GRAPH}, dg AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS n_in, (SELECT count(*) FROM edges WHERE src = id) AS n_out FROM nodes)
            SELECT id, n_in::DOUBLE AS score, n_in, n_out FROM dg ORDER BY n_in DESC, id LIMIT 500""",
        "expand_base": f"""WITH {_PAGES}, {_ROOT}, {_GRAPH}, {_CLOSED}, i AS (SELECT src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM closed WHERE dst IN (SELECT id FROM roots))
            SELECT id FROM roots UNION SELECT dst FROM closed WHERE src IN (SELECT id FROM roots) UNION SELECT src FROM i WHERE n <= 201""",
        "hits_10": _hits_sql(),
        "salsa_hub_3": _salsa_sql("src", "dst", 3),
        "salsa_auth_5": _salsa_sql("dst", "src", 5),
        "bounded_path": _path_sql(),
        "frontier_simulation": _crawl_sql(),
        "crawl_stored_pages": _crawl_sql(8, stored=True),
        "merge_assessors": f"WITH {_MERGED} SELECT * FROM merged",
        "precision_recall_f1_at_k": f"""{_JUDGED}, l AS (SELECT query_id, max(rank) AS retrieved, max(n_rel) AS n_rel FROM j GROUP BY query_id),
            k AS (SELECT *, unnest([5, 10, 15, 20, 30, 100, 200, 500, 1000])::INT AS k FROM l),
            p AS (SELECT k.query_id, k, hits / k AS p, hits / k.n_rel AS r FROM k JOIN j ON j.query_id = k.query_id AND j.rank = least(k, retrieved))
            SELECT query_id, k, round(p, 8) AS precision, round(r, 8) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 8) END AS f1 FROM p""",
        "cutoffs_compat": f"""{_JUDGED}, t AS (SELECT * FROM j WHERE rank <= 21), l AS (SELECT query_id, max(rank) AS retrieved, max(n_rel) AS n_rel FROM t GROUP BY query_id),
            k AS (SELECT *, unnest([5, 10, 15, 20, 30, 100, 200, 500, 1000])::INT AS k FROM l),
            p AS (SELECT k.query_id, k, k > retrieved AS beyond, hits / k AS p, hits / k.n_rel AS r, hits / retrieved AS last FROM k JOIN t ON t.query_id = k.query_id AND t.rank = least(k, retrieved))
            SELECT query_id, k, round(p, 8) AS precision, round(CASE WHEN beyond THEN last ELSE r END, 8) AS recall, CASE WHEN p + r > 0 AND NOT beyond THEN round(2 * p * r / (p + r), 8) END AS f1 FROM p""",
        "eval_means_at_k": f"""{_JUDGED}, l AS (SELECT query_id, max(rank) AS retrieved, max(n_rel) AS n_rel FROM j GROUP BY query_id),
            k AS (SELECT *, unnest([5, 10, 15, 20, 30, 100, 200, 500, 1000])::INT AS k FROM l),
            p AS (SELECT k.query_id, k, hits / k AS p, hits / k.n_rel AS r FROM k JOIN j ON j.query_id = k.query_id AND j.rank = least(k, retrieved))
            SELECT k, count(*) AS n_queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM p GROUP BY k""",
        "average_precision": f"{_JUDGED}, {_AP} SELECT query_id, round(ap, 8) AS ap FROM ap",
        "r_precision": f"{_JUDGED}, {_RP} SELECT query_id, round(r_precision, 8) AS r_precision FROM rp",
        "interpolated_pr": f"{_JUDGED}, {_IP} SELECT query_id, recall_level, round(precision, 8) AS precision FROM ip",
        "ndcg": f"{_JUDGED}, {_ND} SELECT query_id, round(ndcg, 8) AS ndcg FROM nd",
        "eval_summary": f"""{_JUDGED}, {_AP}, {_RP}, {_ND}, q AS (SELECT query_id, count(*) AS retrieved, max(n_rel) AS n_rel, max(hits) AS hits FROM j GROUP BY query_id)
            SELECT count(*) AS n_queries, sum(retrieved)::BIGINT AS retrieved, sum(n_rel)::BIGINT AS relevant, sum(hits)::BIGINT AS relevant_retrieved,
            round(avg(ap), 6) AS map, round(avg(r_precision), 6) AS r_precision, round(avg(ndcg), 6) AS ndcg FROM q JOIN ap USING (query_id) JOIN rp USING (query_id) JOIN nd USING (query_id)""",
        "ndcg_all_judged": f"""{_JUDGED}, {_ND}, a AS (SELECT query_id, max(rank) AS size, sum(CASE WHEN rank = 1 THEN grade ELSE grade / log2(rank) END) AS dcg FROM j GROUP BY query_id),
            w AS (SELECT query_id, CASE WHEN grade = 2 THEN 1 ELSE grade END AS grade, row_number() OVER (PARTITION BY query_id ORDER BY (grade > 0)::INT DESC, doc_id) AS ideal FROM merged),
            b AS (SELECT query_id, sum(CASE WHEN ideal = 1 THEN grade ELSE grade / log2(ideal) END) AS idcg FROM w JOIN a USING (query_id) WHERE ideal <= size GROUP BY query_id)
            SELECT query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 8) AS ndcg FROM a JOIN b USING (query_id)""",
        "eval_report": f"""{_JUDGED}, {_AP}, {_RP}, {_ND}, {_IP}, q AS (SELECT query_id, count(*) AS retrieved, max(n_rel) AS n_rel, max(hits) AS hits FROM j GROUP BY query_id),
            k AS (SELECT query_id, retrieved, n_rel, unnest([5, 10, 15, 20, 30, 50, 100, 200, 500, 1000])::INT AS k FROM q),
            p AS (SELECT k.query_id, k, j.hits / k AS p, j.hits / k.n_rel AS r FROM k JOIN j ON j.query_id = k.query_id AND j.rank = least(k, retrieved)),
            v AS (SELECT 'retrieved' AS measure, NULL::DOUBLE AS cutoff, sum(retrieved)::DOUBLE AS value FROM q UNION ALL SELECT 'relevant', NULL, sum(n_rel) FROM q UNION ALL SELECT 'relevant_retrieved', NULL, sum(hits) FROM q
                UNION ALL SELECT 'interpolated', recall_level, avg(precision) FROM ip GROUP BY recall_level UNION ALL SELECT 'ap', NULL, avg(ap) FROM ap UNION ALL SELECT 'r_precision', NULL, avg(r_precision) FROM rp
                UNION ALL SELECT 'ndcg', NULL, avg(ndcg) FROM nd UNION ALL SELECT 'precision', k, avg(p) FROM p WHERE k <> 50 GROUP BY k
                UNION ALL SELECT 'f1', k, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FROM p WHERE k IN (5, 10, 20, 50, 100) GROUP BY k)
            SELECT measure, cutoff, round(value, 6) AS value FROM v""",
        "pr_curve": f"{_JUDGED}, {_IP} SELECT recall_level, round(avg(precision), 6) AS precision FROM ip GROUP BY recall_level",
    }
