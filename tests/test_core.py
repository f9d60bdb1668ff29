import ast
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.functions import html as H
from seamark.functions import text as X
from seamark.functions import urls as U
from seamark.operators import evaluate as E
from seamark.operators import graph as G
from seamark.operators import index as I
from seamark.operators import search as S
from seamark.operators import topk
from seamark.operators.crawl import crawl, crawl_stored, read_pages, robots_allowed, robots_rules
from seamark.operators.heavy_keys import dominant_link_sources, key_load
from seamark.operators.orphans import missing_references, orphan_references
from seamark.sources import trec as T

DOC = "id string, inlinks array<string>, outlinks array<string>, http_status int, fetched_at timestamp, extra int"


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_key_load_heavy_light_nulls_and_repeats(spark):
    rows = [("hot", f"p{i % 40}") for i in range(4000)] + [(f"k{i}", f"p{i % 7}") for i in range(600)] + [(None, "p"), ("hot", None), ("", "p1"), ("k1", "p1")]
    df = spark.createDataFrame(rows, "k string, v string").withColumn("n", F.lit(1))
    load = key_load(df, "k", "v")
    assert "hot" in load.heavy and load.total == len(rows) - 1
    got = {r["k"]: (r["n_entries"], r["n_values"]) for r in load.result.collect()}
    want = {}
    for k, v in rows:
        if k is not None:
            n, s = want.get(k, (0, set()))
            want[k] = (n + 1, s | ({v} - {None}))
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_key_load_empty(spark):
    load = key_load(spark.createDataFrame([], "k string, v string"), "k", "v")
    assert load.total == 0 and load.result.count() == 0


def test_dominant_sources(spark):
    rows = [(f"http://a/{i}", ["http://s/1", None, ""] + [f"http://t/{i}"] * (i % 2), None, 200, None, 1) for i in range(30)]
    df = spark.createDataFrame(rows + [("x", None, None, None, None, None)], DOC)
    assert [r[0] for r in dominant_link_sources(df).collect()] == ["http://s/1"]
    assert dominant_link_sources(df.limit(0)).count() == 0


def test_missing_references_with_hot_key_and_repeats(spark, monkeypatch):
    monkeypatch.setattr("seamark.operators.orphans.REFS_PER_RANGE", 50)
    refs = [(f"r{i}", "gone") for i in range(500)] + [(f"q{i}", f"k{i}") for i in range(100)] + [("z", None), ("q1", "k1")]
    df = spark.createDataFrame(refs, "key string, target string").withColumn("rng", F.lit(5))
    parents = spark.createDataFrame([(f"k{i}",) for i in range(0, 100, 2)] + [(None,), ("k0",)], "target string")
    got = missing_references(df, "target", parents, "target", "key")
    assert got.columns == ["key", "target", "rng"]
    want = sorted((a, b) for a, b in refs if b is not None and not (b[0] == "k" and int(b[1:]) % 2 == 0))
    assert sorted((r["key"], r["target"]) for r in got.collect()) == want
    assert missing_references(df.limit(0), "target", parents, "target", "key").count() == 0
    assert missing_references(df, "target", parents.limit(0), "target", "key").count() == len(refs) - 1


def test_orphans_states_and_forms(spark):
    import datetime as dt

    t = [dt.datetime(2021, 3, d) for d in (1, 2)]
    rows = [
        ("http://h/a", [None, "", "http://h/gone#x"], ["HTTP://H:80/b#f", "https://h:443/back", "http://x.y", "http://h/gone"], 200, t[0], 1),
        ("http://h/b", None, [], 200, None, 1), ("http://h/b", None, None, 200, None, 1),
        ("http://h/back", None, None, 404, t[0], 1), ("http://h/back", None, None, 200, t[1], 1),
        ("http://h/gone", None, ["http://seed/s"], 200, None, 1), ("http://h/gone", None, None, 410, t[0], 1),
    ]
    got = orphan_references(spark.createDataFrame(rows, DOC), spark.createDataFrame([("http://seed/s", 1.0)], "url string, score double"))
    assert sorted(map(tuple, got.collect())) == [("http://h/a", "inlinks", "http://h/gone#x", "2021-03"), ("http://h/a", "outlinks", "http://h/gone", "2021-03")]


@pytest.mark.parametrize("word, stem", [x.split(":") for x in (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop "
    "falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit triplicate:triplic hopeful:hope revival:reviv "
    "adjustable:adjust replacement:replac adoption:adopt effective:effect probate:probat rate:rate controll:control roll:roll this:thi generalizations:gener").split()])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_url_forms(spark):
    canon = lambda u, p="http://H.com/d/e?q#f": one(spark, U.canonical_url(F.col("u"), F.col("p")), u=u, p=p)
    assert canon("https://A.B:443/X#y") == "http://a.b/X"
    assert canon("http://a.b:8080/") == "http://a.b80/"  # cut anywhere, as the contract says
    assert canon("../x") == "http://h.com/d/x" and canon("/x") == "http://h.com/x" and canon("//C/x") == "http://c/x"
    assert canon("../../x") == "http://h.com/x" and canon("/a/./b/../c?q=../z") == "http://h.com/a/c?q=../z" and canon("/../..") == "http://h.com/" and canon("/a/b/..") == "http://h.com/a/"
    keys = lambda u: one(spark, U.url_keywords(F.col("u")), u=u)
    assert keys("http://www.bbc.com/") == ["bbc"] and keys("http://w.x/a/The_(old)_ship.html") == ["The", "old", "ship"]
    assert keys("http://w.x/Category:Lost_ships") == ["Category", "Lost", "ships"] and keys("http://w.x/a/b-c/") == ["b", "c"]
    assert one(spark, U.useful_link(F.col("u")), u="http://www.x/ship") is True and one(spark, U.useful_link(F.col("u")), u="http://www.x/y/blog") is False
    assert one(spark, U.doc_key(F.col("u")), u="http://a/b/c") == "http-a-b-c"


def test_body_text():
    assert H.body_text("<p>a<p>b <b>c</b></p><table><tr><th>H</th><td>x\ny</td></tr><tr><td>1</td><td>2</td></tr></table>") == "ab cH:x y12\n "
    assert H.body_text(None) == "" and H.body_text("<p>cut") == "cut"
    rows = "<table><tr><th>Ship</th><th>Lost</th></tr><tr><td>Vasa</td><td>1628</td></tr><tr><td>Arizona</td><td><p>1941</p></td></tr></table>"
    assert H.body_text(f"<p>before</p>{rows}<p>after</p>") == "beforeShip:VasaLost:1628Ship:ArizonaLost:1941\n 1941after"
    nested = "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"
    assert H.body_text(nested) == "abbb\n b\n "  # the outer table counts the inner rows, too
    assert H.body_text("<p>a<script>x</script>b</p><td>lost</td><table><tr><td>open") == "abopen\n "


def test_anchors_of_all_forms(spark):
    html = """<A HREF="/x">1</A> <a class='c' href='/y'>2</a> <a href=/z>3</a> <a href="/q?a=1&amp;b=2">4</a> <a data-href="/no">5</a> <a href="#top">6</a> <a href = "/w" >7</a> <abbr href="/v">"""
    df = spark.createDataFrame([("http://www.h.com/d/p", html), ("http://www.h.com/e", None)], "id string, raw_html string")
    assert {r["target"] for r in H.page_links(df).collect()} == {f"http://www.h.com/{x}" for x in ("x", "y", "z", "q?a=1&b=2", "w")}


def test_trec_records_are_written_apart(spark, tmp_path):
    docs = spark.createDataFrame([("k1", "h", "one", 1), ("k2", None, None, 1)], "key string, head string, text string, wave int").coalesce(1)
    records = T.trec_documents(docs, "key", "head", "text", "wave")
    assert records.first()["value"] == "<DOC>\n<DOCNO>k1</DOCNO>\n<HEAD>h</HEAD>\n<TEXT>\none\n</TEXT>\n</DOC>\n"
    T.write_trec(records, str(tmp_path / "t"))
    T.write_trec(records.limit(1), str(tmp_path / "t"))
    texts = sorted(p.read_text() for p in (tmp_path / "t" / "wave=1").glob("part*"))
    assert "".join(texts).count("<DOC>\n<DOCNO>k1") == 2 and all(t.endswith("</DOC>\n") and "</DOC>\n<DOC>" in t or t.count("<DOC>") == 1 for t in texts)


def test_country_penalty(spark):
    score = lambda *w: spark.range(1).select(U.country_penalty(F.array(*[F.lit(x) for x in w]), ["South Korea", "Norway"])).first()[0]
    assert score("norway") == 1.0 and score("South", "Korea") == 1.0 and score("Norway", "ship", "x") == 0.0 and score("ship") == 0.0


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ships sank, a ship sinks"), (2, "the ship"), (3, None), (4, ""), (5, "the a"), (None, "lost ships")], "doc_id long, text string")
    index = I.build_index(docs, str(tmp_path / "i"), stop=("a", "the"))
    index = I.open_index(spark, str(tmp_path / "i"))
    assert {(r["doc_id"], r["term"], r["tf"], r["len"]) for r in index.posts.collect()} == {(1, "ship", 2, 4), (1, "sank", 1, 4), (1, "sink", 1, 4), (2, "ship", 1, 1), (None, "lost", 1, 2), (None, "ship", 1, 2)}
    assert tuple(index.stats.first()) == (6, 7, 7 / 6) and index.terms.where("term = 'ship'").first()["df"] == 3
    queries = spark.createDataFrame([("q1", "the sinking ships"), ("q2", None), ("q3", "area action"), (None, "ship")], "query_id string, text string")
    terms = {(r["query_id"], r["term"]) for r in S.analyzed_queries(queries, ["a", "the"]).collect()}
    assert terms == {("q1", "sink"), ("q1", "ship"), ("q3", "area")} - {("q3", "area")}
    hits = S.default_similarity(index, queries)
    assert [r["doc_id"] for r in hits.orderBy("rank").collect()][0] == 1 and "Exchange hashpartitioning(query_id" in (plan := hits._jdf.queryExecution().toString())
    assert "Exchange hashpartitioning(doc_id" not in plan and "hashpartitioning(query_id, doc_id" not in plan
    assert S.term_lookup(index, "sink").collect()[0]["doc_id"] == 1
    empty = I.build_index(docs.limit(0), str(tmp_path / "e"))
    assert S.bm25(empty, queries).count() == 0


def test_graph_tiny(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "z")], "src string, dst string")
    score = {r["id"]: r["score"] for r in G.pagerank(nodes, edges, rounds=1).collect()}
    assert math.isclose(score["b"], 0.15 / 4 + 0.85 * 0.5 / 4 + 0.85 * 0.25 / 2) and math.isclose(score["c"], score["a"])
    whole = G.pagerank(nodes, edges.where("dst <> 'z'"), rounds=None, most=30)
    assert math.isclose(sum(r["score"] for r in whole.collect()), 1.0)
    h = {r["id"]: r for r in G.hits(nodes, edges, 3).collect()}
    assert math.isclose(sum(r["hub"] ** 2 for r in h.values()), 1.0) and h["d"]["authority"] == 0
    assert {r["id"] for r in G.sinks(nodes, edges).collect()} == {"c", "d"}
    assert math.isclose(sum(r["score"] for r in G.salsa(nodes, edges.where("dst <> 'z'")).collect()), 1.0)
    assert G.pagerank(nodes.limit(0), edges).count() == 0


def test_bounded_path(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 3), (2, 5, -2), (5, 4, -1), (0, 4, 9), (3, 4, 0)], "u int, v int, w int")
    assert tuple(G.bounded_path(edges, 0, 4, [2, 3, 5], 3, 5).first()) == (1, 4, 2)
    assert tuple(G.bounded_path(edges, 0, 4, [2, 3, 5], 1, 5).first()) == (9, 1, 0)
    assert G.bounded_path(edges, 3, 4, [], 0, 3).count() == 0


def test_merge_and_metrics(spark):
    q = lambda *rows: spark.createDataFrame(list(rows), "query_id string, doc_id string, grade int")
    a = q(("1", "x", 0), ("1", "y", 1), ("1", "z", 0), ("1", "w", 2), ("1", "v", 0))
    b, c = q(("1", "x", 2), ("1", "y", 1), ("1", "z", 1)), q(("1", "x", 2), ("1", "z", 0), ("1", "w", 1), ("1", "v", 1))
    assert {r["doc_id"]: r["grade"] for r in E.merge_assessors(a, b, c).collect()} == {"x": 2, "y": 1, "z": 0, "w": 2, "v": 1}
    run = spark.createDataFrame([("1", d, s, None) for d, s in (("p", 9.0), ("x", 8.0), ("y", 8.0), ("y", 7.0), ("n", float("nan")))], "query_id string, doc_id string, grade double, extra int")
    best, qrels = E.best_run(run), E.binarise(q(("1", "x", 2), ("1", "y", 1), ("1", "m", 1), ("2", "x", 0)))
    assert math.isclose(E.average_precision(best, qrels).first()["ap"], (1 / 2 + 2 / 3) / 3)
    k = {r["k"]: r for r in E.at_cutoffs(best, qrels).collect()}
    assert math.isclose(k[5]["precision"], 0.4) and math.isclose(k[1000]["recall"], 2 / 3)
    assert math.isclose(E.ndcg(best, qrels).first()["ndcg"], (1 / math.log2(2) + 1 / math.log2(3)) / 2)
    assert E.interpolated(best, qrels).where("recall_level = 1.0").first()["precision"] == 0


def test_upsert_and_last_wins(spark):
    S = "id string, text string, inlinks array<string>, outlinks array<string>"
    old = spark.createDataFrame([("a", "1", ["x"], None), ("b", "1", ["x"], ["o"]), ("c", "1", [], None)], S)
    new = spark.createDataFrame([("a", "2", ["x", None], []), ("b", "2", ["y"], []), ("c", "2", ["y"], []), ("d", "2", None, None)], S)
    assert {r["id"]: (r["action"], r["text"], sorted(r["inlinks"])) for r in I.upsert(old, new).collect()} == {"a": ("keep", "1", ["x"]), "b": ("update", "2", ["x", "y"]), "c": ("update", "2", ["y"]), "d": ("insert", "2", [])}
    assert I.upsert(old, new, keep_if_empty=True).where("id = 'c'").first()["action"] == "keep"
    rows = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), (None, 1, "z")], "id string, n int, v string")
    assert [tuple(r) for r in I.last_wins(rows, "id", "n").collect()] == [("a", 1, "x")]


def test_text_formats(spark, tmp_path):
    (tmp_path / "qrel").write_text("1 a d1 2\n1 a d1 1\n1 a d2 x\n1 a d3 1 1 b d4 1\n\n")
    assert {tuple(r) for r in T.read_qrels(spark, str(tmp_path / "qrel")).collect()} == {("1", "a", "d1", 1)}
    assert T.read_qrels(spark, str(tmp_path / "qrel"), glued=True).count() == 2
    (tmp_path / "adj").write_text("\na b c\na c\nb\nd x\nd\n")
    nodes, edges = T.read_adjacency(spark, str(tmp_path / "adj"))
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b", "d"] and sorted(map(tuple, edges.collect())) == [("a", "b"), ("a", "c")]
    (tmp_path / "run").write_text("1 u d 1 2.5\n1 u e 2 x\n")
    assert [tuple(r) for r in T.read_run(spark, str(tmp_path / "run"), 2, 4).collect()] == [("1", "d", 2.5)]
    (tmp_path / "q").write_text("1.   Ferry. disaster\nbad\n")
    assert [tuple(r) for r in T.read_queries(spark, str(tmp_path / "q")).collect()] == [("1", "Ferry. disaster")]
    (tmp_path / "stop").write_bytes("été\nthe\n\n".encode("latin-1"))
    assert {r[0] for r in T.read_words(spark, str(tmp_path / "stop")).collect()} == {"été", "the"}
    (tmp_path / "planes").write_text("Engines\nthe\nlanding\n")
    assert {r[0] for r in T.read_words(spark, str(tmp_path / "planes"), "UTF-8", stop=["the"], stem=True).collect()} == {"engin", "land"}
    assert [r[0] for r in T.adjacency_lines(spark.createDataFrame([("a", ["b", "c"])], "id string, links array<string>")).collect()] == ["a b c"]


def test_robots_and_crawl(spark):
    pages = spark.createDataFrame([("http://a/1",), ("http://b/1",), ("http://c/1",)], "id string")
    rules = spark.createDataFrame([("http://a", 403, True), ("http://b", 500, False)], "base_url string, status int, allowed boolean")
    assert sorted(r[0] for r in robots_allowed(pages, rules).collect()) == ["http://b/1", "http://c/1"]
    links = spark.createDataFrame([("http://www.a/s", "http://www.a/ship_x"), ("http://www.a/s", "http://www.a/plane"), ("http://www.a/s", "ftp://x")], "src string, dst string")
    seeds = spark.createDataFrame([("http://www.a/s", 4.0, 1)], "url string, score double, wave int")
    assert [r["url"] for r in crawl(links, seeds, 3, 1).orderBy("turn").collect()] == ["http://www.a/s", "http://www.a/ship_x", "http://www.a/plane"]


def _reference_crawl(links, seeds, ok, most):
    """The reference's loop: one url at a time, a heap with the order of insertion left out of account."""
    front, n_in, log, wave = dict(seeds), {u: 0 for u in seeds}, [], {u: 1 for u in seeds}
    while front and len(log) < most:
        url = min(front, key=lambda u: (-front[u], u))
        score = front.pop(url)
        if url not in ok:
            continue
        log.append((url, score))
        for a, b in links:
            if a == url:
                n_in[b] = n_in.get(b, 0) + 1
                if b in front:
                    front[b] = round(front[b] + 0.01, 2) if n_in[b] < 10 else front[b]
                elif b not in dict(log) and b in ok and b not in wave:
                    wave[b] = wave[url] + 1
                    front[b] = round(0.4 + 0.3 * score + 0.35 / wave[b] + 1e-9, 2)
    return log


def test_crawl_goes_on_to_the_end_over_stored_and_allowed_pages(spark):
    u = lambda i: f"http://www.a/{i:03d}"
    links = {(u(i), u(j)) for i in range(60) for j in (i + 1, (7 * i + 3) % 60, 50)} | {(u(1), "http://www.shut/x"), ("http://www.shut/x", u(90)), (u(1), u(80)), (u(80), u(81))}
    links = sorted((a, b) for a, b in links if a != b)
    ok = {u(i) for i in range(60)}
    args = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(u(0), 4.0, 1)], "url string, score double, wave int")
    pages = spark.createDataFrame([(x,) for x in [*ok, u(90), "http://www.shut/x"]], "id string")
    shut = spark.createDataFrame([("http://www.shut", 403, True)], "base_url string, status int, allowed boolean")
    log = lambda batch, most=1000: crawl(*args, None, batch, pages=pages, robots=shut, most=most).orderBy("turn", F.desc("score"), "url").collect()
    assert [(r["url"], round(r["score"], 2)) for r in log(1, 12)] == _reference_crawl(links, {u(0): 4.0}, ok, 12)
    assert {r["url"] for r in log(4)} == ok  # neither 80, which is not stored, nor the shut host with what is behind it
    assert len(log(25, 33)) == 33


def test_crawl_counts_every_inlink_of_a_batch(spark):
    links = [(f"http://www.a/{i:02d}", t) for i in range(12) for t in ("http://www.a/new", "http://www.a/99")]
    seeds = [(f"http://www.a/{i:02d}", 4.0, 1) for i in range(12)] + [("http://www.a/99", 0.5, 1)]
    got = crawl(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(seeds, "url string, score double, wave int"), None, 12)
    scores = {r["url"]: r["score"] for r in got.collect()}
    assert scores["http://www.a/99"] == 0.59 and scores["http://www.a/new"] == 1.86  # nine of twelve count, with the new page's first one in its own score


def test_broken_crawl_goes_on(spark, tmp_path):
    links = [(f"http://www.a/{i}", f"http://www.a/{i + 1}") for i in range(8)]
    args = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("http://www.a/0", 4.0, 1)], "url string, score double, wave int")
    whole = {tuple(r) for r in crawl(*args, None, 2).collect()}
    saved = str(tmp_path / "saved")
    assert crawl(*args, 4, 2, saved=saved).count() == 4
    assert {tuple(r) for r in crawl(*args, None, 2, saved=saved).collect()} == whole and len(list((tmp_path / "saved").iterdir())) == 2


def test_robots_rules(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: a\nUser-agent: *  # all\nAllow: /private/open\nDisallow: /private\nDisallow:\n"
    robots = spark.createDataFrame([("http://a", 200, body), ("http://b", 200, None), ("http://c", 404, body), (None, 200, body)], "base_url string, status int, body string")
    rules = robots_rules(robots).join(robots.select("base_url", "status", F.lit(None).cast("boolean").alias("allowed")), "base_url")
    pages = spark.createDataFrame([(f"http://{h}{p}", 1) for h in "abcd" for p in ("/private/x", "/private/open/y", "/z", "")], "id string, status int")
    got = {r["id"] for r in robots_allowed(pages, rules).collect()}
    assert got == {r["id"] for r in pages.collect()} - {"http://a/private/x"}
    assert robots_rules(robots, agent="Other-bot").where("base_url = 'http://a'").first()["rules"][0]["path"] == "/"


def test_registered_crawl_leaves_the_seeds(spark, tmp_path):
    from seamark.plans import reference as R

    doc = [("http://www.b/1", 200, [], ["http://www.a/s"]), ("http://www.b/2", 404, [], ["http://www.a/s"]), ("http://www.b/3", 200, [], ["http://www.b/1"])]
    spark.createDataFrame(doc, "id string, http_status int, outlinks array<string>, inlinks array<string>").selectExpr(
        "*", "timestamp_ntz'2021-03-01 00:00:00' fetched_at", "1 batch_no"
    ).write.parquet(str(tmp_path / "document.parquet"))
    spark.createDataFrame([("http://www.a/s", 4.0, 1)], "url string, score double, wave int").write.parquet(str(tmp_path / "crawl_seed.parquet"))
    assert {r["url"] for r in R.queries()["frontier_simulation"](spark, str(tmp_path)).collect()} == {"http://www.a/s", "http://www.b/1", "http://www.b/3"}


def test_registered_base_keeps_up_to_200_sources(spark, tmp_path):
    from seamark.plans import reference as R

    doc = [("http://www.a/root", "The trawler sank.", [])] + [(f"http://www.a/{i:03d}", "Nothing.", ["http://www.a/root"]) for i in range(60)]
    spark.createDataFrame(doc, "id string, text string, outlinks array<string>").selectExpr(
        "*", "timestamp_ntz'2021-03-01 00:00:00' fetched_at", "1 batch_no"
    ).write.parquet(str(tmp_path / "document.parquet"))
    assert R.queries()["expand_base"](spark, str(tmp_path)).count() == 61


def test_top500_of_computed_scores(spark, tmp_path):
    from seamark.plans import reference as R

    out = {"a": "b", "b": "c", "c": "b", "d": "e", "f": "e", "e": "g"}  # b and e have two inlinks each, but b gets c's whole score
    doc = [(f"http://www.a/{x}", "The trawler sank.", [f"http://www.a/{out[x]}"] if x in out else []) for x in "abcdefg"]
    spark.createDataFrame(doc, "id string, text string, outlinks array<string>").selectExpr(
        "*", "timestamp_ntz'2021-03-01 00:00:00' fetched_at", "1 batch_no"
    ).write.parquet(str(tmp_path / "document.parquet"))
    rows = {q: R.queries()[q](spark, str(tmp_path)).collect() for q in ("top500_pagerank", "top500_authorities", "top500_hubs")}
    rank = {r["id"][-1]: r for r in rows["top500_pagerank"]}
    assert set(rank) == set("abcdefg") and rank["b"]["score"] > 2 * rank["e"]["score"] and rank["b"]["n_in"] == rank["e"]["n_in"] == 2
    nodes, edges = R._graph(spark, str(tmp_path))
    for q, kind in (("top500_authorities", "authority"), ("top500_hubs", "hub")):
        assert {r["id"]: r["score"] for r in rows[q]} == {r["id"]: round(r[kind], 8) for r in G.hits(nodes, edges).collect()}


def test_means_at_cutoffs_count_a_null_f1_as_0(spark):
    run = spark.createDataFrame([("1", "x", 1.0, 1), ("1", "y", 0.5, 2), ("2", "z", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("1", "x", 1), ("2", "m", 1)], "query_id string, doc_id string, grade int")
    m = {r["k"]: r for r in E.means_at_cutoffs(run, qrels, (1, 2)).collect()}
    assert m[1]["n_queries"] == 2 and m[1]["precision"] == m[1]["recall"] == m[1]["f1"] == 0.5
    assert m[2]["precision"] == 0.25 and m[2]["recall"] == 0.5 and math.isclose(m[2]["f1"], 1 / 3)


def test_stream_upserts(spark, tmp_path):
    from seamark.streaming.indexing import read_upserts, stream_upserts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    S = "id string, text string, inlinks array<string>, outlinks array<string>, fetched_at timestamp"
    for n, rows in enumerate(([("a", "1", ["x"], None, None)], [("a", "2", ["y"], None, None), ("b", "1", None, None, None)])):
        spark.createDataFrame(rows, S).coalesce(1).write.mode("append").parquet(src)
        stream_upserts(spark.readStream.schema(S).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
        buckets = {p.name: sorted(v.name for v in p.iterdir() if v.name[0] == "v") for p in (tmp_path / "out").iterdir()}
    assert {r["id"]: sorted(r["inlinks"] or []) for r in read_upserts(spark, out).collect()} == {"a": ["x", "y"], "b": []}
    assert sorted(buckets.values()) in ([["version=0", "version=1"], ["version=1"]], [["version=0", "version=1"]])  # only touched buckets are written
    assert read_upserts(spark, str(tmp_path / "none")).count() == 0


def test_nothing_imports_the_optional_subpackage():
    root = Path(__file__).resolve().parents[1] / "seamark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p


def test_catalogue_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p3_found", "p5_found", "bm25_topk"} <= set(entry.queries())


def test_large_nodes_are_spread(spark):
    """A page with most of the edges goes another way than the others, with the same scores."""
    edges = spark.createDataFrame([(f"s{i}", "hub") for i in range(3000)] + [("hub", f"s{i}") for i in range(1500)] + [(f"s{i}", f"s{i + 1}") for i in range(50)], "src string, dst string")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    assert G.Ways(edges, "dst").some and G.Ways(edges, "src").some
    rank = {r["id"]: r["score"] for r in G.pagerank(nodes, edges, rounds=2).collect()}
    out = {}
    for s, d in ((r["src"], r["dst"]) for r in edges.collect()):
        out.setdefault(s, []).append(d)
    want = dict.fromkeys(rank, 1 / len(rank))
    for _ in range(2):
        flow, lost = dict.fromkeys(want, 0.0), sum(v for k, v in want.items() if k not in out)
        for s, ds in out.items():
            for d in ds:
                flow[d] += want[s] / len(ds)
        want = {k: 0.15 / len(want) + 0.85 * (lost / len(want) + flow[k]) for k in want}
    assert all(math.isclose(rank[k], want[k]) for k in want)
    h = G.hits(nodes, edges, 3)
    assert h.orderBy(F.desc("authority")).first()["id"] == "hub" and math.isclose(h.agg(F.sum(F.pow("authority", 2))).first()[0], 1.0)
    assert math.isclose(G.salsa(nodes, edges).agg(F.sum("score")).first()[0], 1.0)


def test_synced_documents_and_blocks(spark):
    pages = spark.createDataFrame([("http://a/1", "t", ["x"], None), ("http://b/2", None, None, ["y"])], "id string, text string, inlinks array<string>, outlinks array<string>")
    edges = spark.createDataFrame([("http://a/1", "http://b/2"), ("http://a/1", "http://c/9"), ("http://b/2", "http://c/8")], "src string, dst string")
    got = {r["id"]: (r["inlinks"], r["outlinks"]) for r in G.synced_documents(pages, edges, [spark.createDataFrame([("http://c/8",)], "id string")]).collect()}
    assert got == {"http://a/1": ([], ["http://b/2", "http://c"]), "http://b/2": (["http://a/1"], ["http://c/8"])}
    many = spark.createDataFrame([(f"s{i:03}", "d") for i in range(95)] + [("s1", "e")], "src string, dst string")
    blocks = [r for r in G.inlink_blocks(many, 10).collect() if r["id"] == "d"]
    assert len(blocks) > 5 and sorted(x for b in blocks for x in b["links"]) == [f"s{i:03}" for i in range(95)]
    with pytest.raises(ValueError):
        G.expand_base(pages.select("id"), pages.select("id"), edges, order="x")
    assert G.expand_base(pages.select("id").limit(1), pages.select("id"), edges, order="hash").count() == 2


def test_crawl_of_stored_html(spark):
    link = lambda *u: "".join(f"<a href='{x}'>x</a>" for x in u)
    rows = [("http://www.a/1", "text/html", link("/2", "/3#top", "http://www.shut/4")), ("http://www.a/2", "text/html", link("/5")), ("http://www.a/3", "image/png", link("/5")),
            ("http://www.shut/4", "text/html", link("/5")), ("http://www.a/5", "text/html", None), ("http://www.a/6", "text/html", "<p>alone")]
    pages = spark.createDataFrame(rows, "id string, headers string, raw_html string")
    seeds = spark.createDataFrame([("http://www.a/1", 4.0, 1)], "url string, score double, wave int")
    rules = spark.createDataFrame([("http://www.shut", 403, True)], "base_url string, status int, allowed boolean")
    assert {r["url"] for r in crawl_stored(pages, seeds, 10, rules).collect()} == {"http://www.a/1", "http://www.a/2"}
    assert {r["url"] for r in crawl_stored(pages, seeds, 10, open_until=0).collect()} == {"http://www.a/1"}
    texts, links = read_pages(pages, rules)
    assert {r["id"] for r in texts.collect()} == {"http://www.a/1", "http://www.a/2", "http://www.a/6"} and links.count() == 4


def test_report_and_ideal(spark):
    run = E.best_run(spark.createDataFrame([("1", d, s) for d, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "query_id string, doc_id string, grade double"))
    qrels = spark.createDataFrame([("1", "b", 1), ("1", "x", 1), ("1", "y", 0)], "query_id string, doc_id string, grade int")
    assert math.isclose(E.ndcg(run, qrels).first()["ndcg"], 1.0)  # a gain at rank 2 is not discounted
    assert math.isclose(E.ndcg(run, qrels, ideal="qrels").first()["ndcg"], 0.5)
    rows = {(r["measure"], r["cutoff"]): r["value"] for r in E.report(run, qrels).collect()}
    assert rows["relevant", None] == 2 and rows["relevant_retrieved", None] == 1 and rows["precision", 5.0] == 0.2 and math.isclose(rows["f1", 5.0], 2 * 0.2 * 0.5 / 0.7)
    assert E.report(run, qrels, per_query=True).where("query_id = '1'").count() == len(rows) and E.report(run.limit(0), qrels).count() == 0
    with pytest.raises(ValueError):
        E.ndcg(run, qrels, ideal="x")


def test_interpolation_of_a_long_ranking_reads_each_rank_once(spark):
    # a frame from each row to the last one takes time with the square of the longest ranking
    best = spark.range(60_000).selectExpr("'1' AS query_id", "CAST(id AS STRING) AS doc_id", "CAST(-id AS DOUBLE) AS score", "CAST(id + 1 AS INT) AS rank")
    qrels = spark.range(0, 60_000, 3).selectExpr("'1' AS query_id", "CAST(id AS STRING) AS doc_id", "1 AS grade")
    for df in (E.interpolated(best, qrels), E.pr_curve(best, qrels)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    got = {r["recall_level"]: r["precision"] for r in E.interpolated(best, qrels).collect()}
    assert got[0.0] == 1.0 and math.isclose(got[1.0], 20_000 / 59_998) and len(got) == 11


def test_report_judges_the_run_once(spark):
    run = E.best_run(spark.createDataFrame([("1", d, s) for d, s in (("a", 3.0), ("b", 2.0))], "query_id string, doc_id string, grade double"))
    plan = E.report(run, spark.createDataFrame([("1", "b", 1)], "query_id string, doc_id string, grade int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "parquet" in plan  # all measures read the stored rows, not the run and the judgements


def test_search_of_many_queries_in_blocks(spark, tmp_path, monkeypatch):
    # equal queries, equal documents, a term that all documents hold, more hits than are asked for; against plain sums
    texts = [" ".join(["sea"] + [f"w{i % m}" for m in (2, 3, 7, 11)] * (1 + i % 3)) for i in range(400)]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)] + [(5000, None)], "doc_id long, text string").repartition(5)
    index = I.build_index(docs.where("text IS NOT NULL"), str(tmp_path / "i"), stop=("the",))
    asked = ["w1 w5", "w5 w1", "sea", "sea w10 w10", "w6 w2 w9 w0", "nowhere", "nowhere w3"] * 40
    queries = spark.createDataFrame([(f"q{i}", f"{q} w{i % 9}") for i, q in enumerate(asked)], "query_id string, text string")
    monkeypatch.setattr("seamark.operators.topk.LEAST_GROUPS", 5)
    bags = [{t: x.split().count(t) for t in x.split()} for x in texts]
    lens, df = [len(x.split()) for x in texts], {}
    for b in bags:
        for t in b:
            df[t] = df.get(t, 0) + 1
    avg, weight = sum(lens) / len(lens), S.bm25_weight()
    for k in (7, 1000):
        out = S.bm25(index, queries, k)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() >= 8  # a task for each share of the queries, and no score is shuffled
        got = {}
        for r in out.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
        for i, q in enumerate(asked):
            terms = f"{q} w{i % 9}".split()
            hits = []
            for n, b in enumerate(bags):
                own = [t for t in sorted(set(terms)) if t in b]
                if own:
                    score = sum(weight.query(400, df[t], terms.count(t)) * weight.posting(b[t], lens[n], avg) for t in own)
                    hits.append((-round(score, 9), n * 3))
            want = [(r + 1, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k])]
            assert sorted(got[f"q{i}"]) == want
    assert {r["rank"] for r in S.page_of_hits(index, queries, 21, 30).collect()} == set(range(21, 31))


def test_default_similarity_shuffles_no_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seamark.operators.topk.LEAST_GROUPS", 1)
    docs = spark.createDataFrame([(i, f"sea w{i % 3} w{i % 5}") for i in range(60)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", f"w{i % 3} " * (1 + i // 3 % 4) + "tug") for i in range(1200)], "query_id string, text string")
    index = I.build_index(docs, str(tmp_path / "i"))
    out = S.default_similarity(index, queries, 5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    # w0 to w2 stand on 20 documents each or 24 with the second word; the ones that hold the word twice come first
    assert len(got) == 1200 and all(got[f"q{i}"] == [x for x in range(60) if x % 3 == i % 3 == x % 5][:4] + [x for x in range(60) if (x % 3 == i % 3) != (x % 5 == i % 3)][:1] for i in range(1200))


def test_search_scores_few_documents_in_full(monkeypatch):
    # sums of a byte tell which documents can be among the first; short, repeated, weightless and very long queries, in several blocks, against plain sums
    rng, n, n_terms, k = np.random.default_rng(3), 8000, 130, 20
    monkeypatch.setattr(topk, "BLOCK", 60_000)
    tf = (rng.random((n, n_terms)) < rng.random(n_terms) ** 3 / 2) * rng.integers(1, 6, (n, n_terms))
    tf[n // 2 :] = tf[: n // 2]  # ties
    groups = [(sorted(rng.choice(n_terms, m, False).tolist()), [float(x) for x in rng.choice([0.5, 1.7, 3.0], m)], [f"q{i}"]) for i, m in enumerate([1, 2, 3, 4, 5] * 40 + [120])]
    groups[7][1][0] = 0.0
    search, scored = topk._Search([f"t{i:03}" for i in range(n_terms)], groups, lambda tf, length, avg: tf / (tf + length / avg), 1.0, k), []
    keep = search._keep
    monkeypatch.setattr(search, "_keep", lambda g, score, *x: (scored.append((g, len(score))), keep(g, score, *x)))
    for a in range(0, n, 1000):
        term, doc = np.nonzero(tf[a : a + 1000].T)
        used, df = np.unique(term, return_counts=True)
        search.add((pa.array(range(a, a + 1000)), np.ones(1000, np.int32), pa.array([f"t{i:03}" for i in used]), np.cumsum(df), doc.astype(np.int32), tf[a : a + 1000].T[term, doc].astype(np.int32)))
    got: dict = {}
    for r in (r for b in search.found(pa.string(), pa.int64(), 1) for r in b.to_pylist()):
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    weight, matched = tf / (tf + 1.0), 0
    for terms, factors, (q,) in groups:
        score = sum(weight[:, t] * f for t, f in zip(terms, factors))
        found = np.flatnonzero(tf[:, terms].any(axis=1))
        order = found[np.lexsort((found, -score[found]))][:k]
        assert got.get(q, []) == list(zip(order.tolist(), score[order].tolist()))
        matched += len(found)
    assert sum(m for g, m in scored if g not in (7, 200)) < matched / 5


def test_page_of_hits_scores_few_documents_in_full(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5000)
    n, scored = 20_000, []
    tf = np.stack([1 + np.arange(n) % 7, np.arange(n) * 13 % 11])
    search = topk._Search(["a", "b"], [([0, 1], [1.0, 2.0], ["q"])], lambda tf, length, avg: tf / (tf + length / avg), 1.0, 30)
    keep = search._keep
    monkeypatch.setattr(search, "_keep", lambda g, score, *x: (scored.append(len(score)), keep(g, score, *x)))
    for i in range(0, n, 2000):
        term, doc = np.nonzero(tf[:, i : i + 2000])
        search.add((pa.array(range(i, i + 2000)), np.ones(2000, np.int32), pa.array(["a", "b"]), np.cumsum(np.bincount(term)), doc.astype(np.int32), tf[:, i : i + 2000][term, doc].astype(np.int32)))
    (page,) = search.found(pa.string(), pa.int64(), 21)
    score = (tf / (tf + 1.0)).T @ [1.0, 2.0]
    assert page["rank"].to_pylist() == list(range(21, 31)) and page["doc_id"].to_pylist() == np.lexsort((np.arange(n), -score))[20:30].tolist()
    assert sum(scored) < n / 10


def test_page_of_hits_holds_no_more_postings_than_asked(spark, tmp_path, monkeypatch):
    # of a block, only postings of the queries' terms are held, so that a block has many documents; like queries stay together in runs
    search = topk._Search(["b"], [([0], [1.0], ["q"])], lambda tf, length, avg: tf / (tf + length / avg), 1.0, 2)
    search.add((pa.array([7, 8, 9]), np.array([2, 1, 2], np.int32), pa.array(["a", "b", "c"]), np.array([3, 5, 6]), np.array([0, 1, 2, 0, 2, 1], np.int32), np.ones(6, np.int32)))
    assert search.held == 2 and next(search.found(pa.string(), pa.int64(), 1))["doc_id"].to_pylist() == [7, 9]
    monkeypatch.setattr(topk, "LEAST_GROUPS", 1)
    monkeypatch.setattr(topk, "LARGE", 500)  # each core reads such an index once
    docs = spark.createDataFrame([(i, f"w{i % 300} w{i % 200}") for i in range(600)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i}") for i in range(300)], "query_id string, text string")
    pages = S.page_of_hits(I.build_index(docs, str(tmp_path / "index")), asked, 2, 3)
    assert pages.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism + 2
    held = {i: [x for x in range(600) if i in (x % 300, x % 200)] for i in range(300)}
    both = {i: sorted(held[i], key=lambda x: (x % 300 != x % 200, x)) for i in held}  # twice the word comes first
    assert sorted(map(tuple, pages.select("query_id", "doc_id").collect())) == sorted((f"q{i}", x) for i in both for x in both[i][1:3])


def test_tokens_from_bytes(spark, tmp_path):
    # the index's tokens of Latin texts come from the bytes of a batch; all others, and what they are, from the JVM
    texts = ["".join(map(chr, range(1, 256))), *(f"a{chr(i)}B{chr(i)} {chr(i)}" for i in range(1, 1100)), *(f"É{chr(i)}é" for i in range(0x1FF0, 0x2080)), "abc", "def", None, "", "Ünter 12€ – «Straße»…", "Œuvre İI", "\U0001f600x𝐀", "Ende"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string").repartition(3)
    asked = lambda df: sorted(map(tuple, df.select("doc_id", "term", "tf").collect()))
    row, token = X.latin_tokens(pa.array(["abc", None, "Déf g", "", "hi"]).slice(1))
    assert row.tolist() == [1, 1, 3] and token.to_pylist() == ["déf", "g", "hi"] and not len(X.latin_tokens(pa.array([None], pa.string()))[0])
    assert asked(I.build_index(docs, str(tmp_path / "index"), stem=False).posts) == asked(I.postings(docs))


def test_page_of_hits_is_cut_within_the_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seamark.operators.topk.LEAST_GROUPS", 1)
    docs = spark.createDataFrame([(i, "sea " * (1 + i % 2)) for i in range(50)], "doc_id long, text string").repartition(2)
    index = I.build_index(docs, str(tmp_path / "i"))
    queries = spark.createDataFrame([("a", "sea"), ("b", "SEA, sea"), ("c", "none")] + [(f"r{i}", "sea " * i) for i in range(3, 9)], "query_id string, text string")
    plan = S.page_of_hits(index, queries, 24, 28)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {q: [r["doc_id"] for r in S.page_of_hits(index, queries, 24, 28).orderBy("rank").where(F.col("query_id") == q).collect()] for q in "abc"}
    assert got == {"a": [47, 49, 0, 2, 4], "b": [47, 49, 0, 2, 4], "c": []}
