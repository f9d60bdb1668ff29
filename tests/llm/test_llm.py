import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm.boilerplate import frame_lines, judge, main_text
from seamark.llm.consensus import Consensus
from seamark.llm.leaks import HeldOut, leaked_passages, leaks, without_leaks
from seamark.llm.neardup import NearDuplicates, WordHashes, frequent_tokens
from seamark.llm.pageblocks import content_blocks, parse
from seamark.llm.repetition import repeats, repetition, repetitive
from seamark.llm.spam import page_evidence, sentences, spam_pages
from seamark.llm.tokens import Encoding, _cut, chunk_reuse, encoder, repaired, token_ids, vocabulary
from seamark.llm.topn import top_n
from seamark.llm.words import words

PAGE = "id string, text string, raw_html string, outlinks array<string>, frame int"
HTML = """<html><head><title>t</title></head><body><ul class="m"><li><a href="/a">Home</a> - <a href="/b">Maps</a></li></ul>
<div class="c">
<h1>The old ferry sank.</h1>
<p>The old ferry sank near the harbour in heavy fog, and all of its crew were saved by a tug.</p>
<ul class="m"><li>Share this page</li></ul>
<p>An inquiry into the loss of the ferry was opened by the port on the following Monday.</p>
</div>
<ul class="m"><li>Most read</li><li>* the lost tug</li></ul>
</body></html>"""
TEXT = "Home - Maps\nThe old ferry sank near the harbour in heavy fog, and all of its crew were saved by a tug.\n\nShare this page\nAn inquiry into the loss of the ferry was opened by the port on the following Monday.\nMost read\n* the lost tug"


@pytest.mark.parametrize("common", [50_000, 1])
def test_frame_lines(spark, monkeypatch, common):
    monkeypatch.setattr("seamark.llm.boilerplate.COMMON", common)
    rows = [("p1", TEXT, HTML, None, 1), ("p1", TEXT, None, None, 1), ("p2", TEXT, None, [], 1), ("p3", None, HTML, None, 1), (None, TEXT, HTML, None, 1), ("p4", "", HTML, None, 1), ("p5", TEXT, "", None, 1)]
    df = spark.createDataFrame(rows, PAGE)
    got = {}
    for r in frame_lines(df).collect():
        got.setdefault(r["id"], set()).add(r["line_no"])
    assert got == {k: {1, 4, 6, 7} for k in ("p1", "p2", "p5")}
    body = {r["id"]: r["body"] for r in main_text(df).collect()}
    assert body["p1"].startswith("The old ferry") and body["p4"] == "" and set(body) == {"p1", "p2", "p4", "p5"}
    assert frame_lines(df.limit(0)).count() == 0


ARTICLE = """<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<article><h2>The ferry and the reef</h2><p>The ferry left the harbour in the evening with more passengers than it was allowed to carry, and nobody checked the list.</p>
<ul><li>Three of the crew were rescued.</li><li>Two boats were lost.</li></ul>
<div class="inset"><p>A nested paragraph tells what the pilot saw from the bridge that night, before the lights went out on the shore.</p></div>
<table><tr><th>Ship</th><th>Lost</th></tr><tr><td>Vasa</td><td>1628</td></tr></table>
<blockquote>We never saw the reef, said the mate.</blockquote>
<p>The inquiry opened a week later in the town hall, where the owners and the crew gave very different accounts of it.</p></article>
<div class="promo"><p>Sign up for our letter</p></div><footer><p>(c) 2020 The Paper. All rights reserved</p></footer></body></html>"""
FRAME = {"Home", "News", "Sign up for our letter", "(c) 2020 The Paper. All rights reserved"}


@pytest.mark.parametrize("change", [
    lambda h: h, lambda h: h.replace("\n", ""),
    lambda h: h.replace("<article>", '<div id="wrap"><div id="c">').replace("</article>", "</div>").replace("</footer>", "</footer></div>"),
    lambda h: h.replace("<article>", "").replace("</article>", ""),
])
def test_lists_tables_and_nested_blocks_are_content(spark, change):
    page = parse(change(ARTICLE))
    got = {b[1] for b, content in zip(page.blocks, content_blocks(page)[0]) if content is not False}
    body = {b[1] for b in page.blocks} - FRAME
    assert body - {"The ferry and the reef"} <= got and not got & (FRAME - {"Sign up for our letter"})
    text = "\n".join(b[1] for b in page.blocks)
    lines = {text.split("\n")[r["line_no"] - 1] for r in frame_lines(spark.createDataFrame([("p", text, change(ARTICLE), None, 1)], PAGE)).collect()}
    assert FRAME - {"Sign up for our letter"} <= lines and not lines & (body - {"The ferry and the reef"})


def test_long_frame_lines_need_smoothing_and_clusters():
    rows = "".join(f"<div class='f'><p><a href='/{i}'>x</a> <b>entry</b> of the day number {i} in the long list</p></div>" for i in range(40))
    body = "".join(f"<p>{'The pilot saw the reef from the bridge that night. ' * 3}</p>" for _ in range(3))
    page = parse(f"<html><body><div id='all'><div id='side'>{rows}</div><div id='c'>{body}</div></div></body></html>")
    content = lambda **how: {b[0] for b, x in zip(page.blocks, content_blocks(page, **how)[0]) if x}
    assert all(x.endswith("div.c>p") for x in content()) and not all(x.endswith("div.c>p") for x in content(clustered=False))


def test_boxes_beside_many_bodies_are_frame(spark):
    """A prompt in a box of its own recurs beside different bodies; the list of an article that is copied does not."""
    page = lambda k, box: f"<html><body><div><p>Report {k} tells what the pilot number {k} saw from the bridge that night.</p>{box}<p>Its end came late.</p></div></body></html>"
    text = lambda k, box: f"Report {k} tells what the pilot number {k} saw from the bridge that night.\n{box}\nIts end came late."
    rows = [(f"a{k}", text(k, "Follow us"), page(k, "<div><p>Follow us</p></div>"), None, 1) for k in range(4)]
    rows += [(f"b{k}", text(9, "Three were rescued"), page(9, "<ul><li>Three were rescued</li></ul>"), None, 1) for k in range(6)]
    got = {(r["id"], r["line_no"]) for r in frame_lines(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {(f"a{k}", 2) for k in range(4)}


def test_long_box_without_html(spark):
    entries = "\n".join(f"* the {w} tug" for w in "red blue green grey pale dark long low wide old".split())
    text = f"{TEXT.rpartition(chr(10))[0]}\n{entries}\nA second report on the ferry was read to the port on Friday.\nPort and crew"
    got = frame_lines(spark.createDataFrame([("p1", TEXT, HTML, None, 1), ("p2", text, None, None, 1)], PAGE)).where("id = 'p2'").collect()
    assert {r["line_no"] for r in got} == {1, 4, *range(6, 17)}


def test_cut_html_keeps_what_it_says():
    quality, frame, undecided, *_ = judge(TEXT, HTML[: HTML.index("Most read")])
    assert quality == 1 and frame == [1, 4, 6, 7] and not undecided


def test_consensus(spark, monkeypatch):
    random.seed(4)
    truth = {f"d{i}": random.choice((0, 1, 2)) for i in range(120)}
    rows = []
    for d, t in truth.items():
        for a in range(6):
            g = t if random.random() < (0.9 if a < 4 else 0.0) else random.choice([x for x in (0, 1, 2) if x != t])
            rows.append(("q", f"a{a}", d, g, None))
    rows += [("q", "a0", "d0", 7, None), (None, "a0", "d0", 1, None), ("q", None, "d0", 1, None), ("q", "a1", "only-void", None, None), rows[0]]
    df = spark.createDataFrame(rows, "query_id string, assessor_id string, doc_id string, grade int, graded_at timestamp").withColumn("m", F.lit(3))
    c = Consensus(df, rounds=4)
    got = {r["doc_id"]: r["grade"] for r in c.items.collect()}
    assert set(got) == set(truth) and sum(got[d] == t for d, t in truth.items()) >= 116
    who = {r["assessor_id"]: r for r in c.annotators.collect()}
    assert [who[f"a{i}"]["reliable"] for i in range(6)] == [True] * 4 + [False] * 2
    assert all(r["low"] <= r["reliability"] <= r["high"] for r in who.values())
    assert c.turns <= 30 and all(r["model_grade"] in (0, 1, 2) for r in c.items.collect())
    # items whose votes are parted give the same model
    monkeypatch.setattr("seamark.llm.consensus.ITEM_VOTES", 2)
    parted = Consensus(df, rounds=4)
    assert parted.salted and {r["doc_id"]: (r["grade"], round(r["posterior"], 9), r["n_votes"]) for r in parted.items.collect()} == {
        r["doc_id"]: (r["grade"], round(r["posterior"], 9), r["n_votes"]) for r in c.items.collect()
    }
    empty = Consensus(df.limit(0), rounds=1)
    assert empty.items.count() == 0 and empty.agreement.first()["alpha"] is None


def test_agreement_is_one_without_disagreement(spark):
    df = spark.createDataFrame([("q", a, d, g, None) for a in "ab" for d, g in (("x", 0), ("y", 2))], "query_id string, assessor_id string, doc_id string, grade int, graded_at timestamp")
    assert Consensus(df, rounds=0).agreement.first()["alpha"] == 1.0


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    random.seed(7)
    vocab = [f"w{i}" for i in range(60)]
    texts = [[random.choice(vocab) for _ in range(random.choice([3, 8, 30, 60]))] for _ in range(60)]
    for t in list(texts):
        e = list(t)
        for _ in range(random.choice([1, 2, 6])):
            e[random.randrange(len(e))] = random.choice(vocab)
        texts.append(e)
    rows = [(f"k{i:03}", " ".join(t)) for i, t in enumerate(texts)] + [("c1", "Same text, here it is."), ("c2", "Same text, here it is."), ("c2", "Same text, here it is."), ("s1", "two words"), ("s2", "two words"), ("n", None), ("e", ""), (None, "Same text, here it is.")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("rep", F.lit("x"))
    sets = {}
    for k, t in rows:
        w = words(t)
        if k:
            sets.setdefault(k, set(zip(w, w[1:], w[2:])))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    n = NearDuplicates(df)
    assert {tuple(r) for r in n.key_pairs().collect()} == want and ("c1", "c2") in want
    assert n.classes().where("key = 'c2'").first()["rep"] == "c1"
    assert NearDuplicates(df.limit(0)).key_pairs().count() == 0
    # few listed tokens, parted groups and tokens, and joins in place of broadcasts change nothing
    for name, value in (("LISTED", 40), ("GROUP_CLASSES", 2), ("TOKEN_TEXTS", 1), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(f"seamark.llm.neardup.{name}", value)
    assert {tuple(r) for r in NearDuplicates(df).key_pairs().collect()} == want


def test_frequent_tokens_are_the_most_frequent(spark):
    sets = [[k for k in range(60) if k % 3 == 0 or i % (k + 1) == 0] for i in range(40)]
    tokens = [[(k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in s] for s in sets]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens array<long>")
    count = {}
    for s in sets:
        for k in s:
            count[k] = count.get(k, 0) + 1
    keys, logs, least = frequent_tokens(df)
    assert least == 2 and len(keys) == sum(n > 1 for n in count.values()) and list(keys) == sorted(keys)
    keys, logs, least = frequent_tokens(df, 25)
    assert least > 2 and len(keys) == sum(n >= least for n in count.values()) <= 25 and min(logs) >= 1 + 12 * math.log2(least) - 1


def test_large_copy_class_is_a_star(spark, monkeypatch):
    monkeypatch.setattr("seamark.llm.neardup.FULL_CLASS", 5)
    df = spark.createDataFrame([(f"k{i:02}", "one and the same text") for i in range(9)], "id string, text string")
    assert {tuple(r) for r in NearDuplicates(df).key_pairs().collect()} == {("k00", f"k{i:02}") for i in range(1, 9)}
    assert NearDuplicates(df).key_pairs(full_class=None).count() == 36


def formal_words(body: str) -> tuple[int, int]:
    _, _, segment, page, good = sentences([body], WordHashes())
    return len(segment), int(good[segment].sum()) if len(segment) else 0


def test_sentences_by_form():
    assert formal_words("The old ferry sank near the harbour. buy cheap winch buy cheap") == (12, 7)
    assert formal_words("") == (0, 0) and formal_words("?!") == (0, 0)
    assert formal_words("Паром затонул у входа в гавань! см. http://a.b.example/c.d") == (13, 6)
    assert formal_words("古い船が沈んだ。乗組員は救助された。") == (16, 16)
    assert formal_words("buy cheap winch buy cheap winch buy cheap winch buy cheap.")[1] == 0


REPORTS = {
    "ru": "Старый паром затонул у входа в гавань во время густого тумана. Всех членов экипажа спас проходивший мимо буксир. Порт начал расследование в понедельник, и водолазы ищут судовой колокол. "
    "Никто не знает, почему капитан оставил карты дома. На этой неделе ожидался сильный шторм с запада. Владельцы судна пока не ответили на вопросы.",
    "pl": "Stary prom zatonął przy wejściu do portu podczas gęstej mgły. Całą załogę uratował przepływający obok holownik. Port wszczął w poniedziałek dochodzenie, a nurkowie szukają dzwonu. "
    "Nikt nie wie, dlaczego kapitan zostawił mapy w domu. W tym tygodniu spodziewano się silnego sztormu z zachodu. Właściciele statku na razie nie odpowiedzieli na pytania.",
    "ja": "古いフェリーが濃い霧の中で港の入口近くに沈んだ。乗組員は全員、通りかかった曳船に救助された。港は月曜日に調査を始め、潜水士が鐘を探している。船長がなぜ海図を家に置いてきたのかは誰にも分からない。",
}


def test_spam_needs_no_word_list(spark):
    r = random.Random(8)
    parts = [
        ["The old ferry", "A small tug", "The grain ship", "Another trawler"], ["sank near the harbour", "ran onto the reef", "broke her mooring", "was seen off the coast"],
        ["before dawn on Monday", "in the heavy fog", "during the winter gale", "after the long voyage"],
        ["and all of the crew were saved", "but nobody was told of it", "while the port was closed", "so the owners asked for help"],
    ]
    every = [" ".join(x) + "." for x in itertools.product(*parts)]
    rows = [(f"http://h{k % 7}/{k}", " ".join(r.sample(every, 8)), None, None, 1) for k in range(60)]
    rows += [(f"http://{k}/1", t, None, None, 1) for k, t in REPORTS.items()]
    known = [w for w in {w for x in every for w in words(x)} if len(w) > 3]
    salad = " ".join(" ".join(r.choices(known, k=7)).capitalize() + "." for _ in range(20))
    df = spark.createDataFrame([*rows, ("http://spam/1", salad, None, None, 1)], PAGE)
    assert [x[0] for x in spam_pages(df).collect()] == ["http://spam/1"]
    assert spam_pages(df, replication=False).count() == 0


def test_spam(spark):
    good = (
        "The old ferry sank near the harbour in heavy fog. All of its crew were saved by a passing tug before dawn. An inquiry was opened by the port on Monday, "
        "and divers looked for the bell. Nobody knows why the captain had left his charts at home. A storm from the west was expected that week."
    )
    stuffed = " ".join(random.Random(1).choices(["cheap", "winch", "gps", "rope", "offer"], k=120))
    rows = [("http://a/1", good, None, None, 1), ("http://b/2", stuffed, None, ["http://x/1", None], 1), ("http://b/3", "cheap winch", None, None, 1), ("http://b/4", None, None, None, 1), ("http://b/5", "", None, None, 1)]
    df = spark.createDataFrame(rows, PAGE).withColumn("host", F.lit(1))
    assert [r[0] for r in spam_pages(df).collect()] == ["http://b/2"]
    assert page_evidence(df).count() == 4 and spam_pages(df.limit(0)).count() == 0


def test_top_n_with_ties_hot_group_and_dirt(spark, monkeypatch):
    monkeypatch.setattr("seamark.llm.topn.BLOCK_ROWS", 50)
    random.seed(2)
    rows = [("hot", f"d{random.randrange(300):03}", float(random.randrange(4))) for _ in range(1500)] + [(f"g{i}", f"d{i}", 1.0) for i in range(5)]
    rows += [("hot", "d000", float("nan")), ("hot", None, 9.0), (None, "d1", 9.0), ("hot", "d1", None), ("g0", "d0", -0.0)]
    df = spark.createDataFrame(rows, "q string, d string, s double").withColumn("g", F.lit(0)).withColumn("i", F.lit(0)).repartition(3)
    best = {}
    for q, d, s in rows:
        if q and d and s is not None and s == s:
            best.setdefault(q, {})[d] = max(best.get(q, {}).get(d, s), s)
    want = {(q, d, r) for q, m in best.items() for r, (d, _) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:7], 1)}
    assert {(r["q"], r["d"], r["rank"]) for r in top_n(df, "q", "d", "s", 7).collect()} == want
    monkeypatch.setattr("seamark.llm.topn.MAX_BOUNDS", 1)  # the other bounds are joined by a shuffle
    more = df.unionByName(df.where("q = 'hot'").withColumn("q", F.lit("hot2")))
    got = {(r["q"], r["d"], r["rank"]) for r in top_n(more, "q", "d", "s", 7).collect()}
    assert got == want | {("hot2", d, k) for q, d, k in want if q == "hot"}
    assert top_n(df.limit(0), "q", "d", "s").count() == 0
    with pytest.raises(ValueError):
        top_n(df, "q", "d", "s", 0)


def odd_texts():
    r = random.Random(5)
    cjk = [chr(c) for c in range(0x4E00, 0x5600)]
    out = [None, "", " ", "\n \t" * 900, "a" * 4000, "''s 't" * 500, "🚢" * 900 + "foo bar" * 40, "İ é ½ ﬁ", "x1" * 2000]
    for mix in ([], [" a"], ["'s", " "], ["。"]):
        out += ["".join(r.choice(cjk) if r.random() > 0.01 or not mix else r.choice(mix) for _ in range(n)) for n in (700, 9000)]
    return out + ["".join(r.choice(["The ferry sank. ", "harbour's ", "é ", "12 "]) for _ in range(3000))]


def test_token_ids_equal_the_encoder(spark):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(3, texts[-1]), (None, "null key")]
    got = token_ids(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)))
    coder = encoder(vocabulary())
    want = sorted((str(k), tuple(coder.encode_ordinary(t) if t else [])) for k, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got.collect()) == want
    assert chunk_reuse(spark.createDataFrame([], "doc_id long, text string")).first()["n_chunks"] == 0


def test_uncertain_joins_are_repaired():
    texts, coder = [t for t in odd_texts() if t], encoder(vocabulary())
    whole, no, lo, hi, marked, _ = _cut(pa.array(texts))
    assert sum(marked) > 10
    for k, t in enumerate(texts):
        pieces = [(bool(m), bytes(whole[a:b]), np.array(coder.encode_ordinary(bytes(whole[a:b]).decode()), np.int32)) for a, b, m, n in zip(lo, hi, marked, no) if n == k]
        assert repaired(pieces, coder).tolist() == coder.encode_ordinary(t)


@pytest.mark.parametrize("limits", [(1_000_000, 100_000), (0, 5)])
def test_each_distinct_chunk_is_encoded_once(spark, monkeypatch, limits):
    for name, value in zip(("BROADCAST_PLACES", "HOT_PLACES"), limits):
        monkeypatch.setattr(f"seamark.llm.tokens.{name}", value)
    r = random.Random(3)
    lines = [" ".join(r.choices(["ferry", "sank", "harbour", "fog", "1912", "crew", "tug"], k=12)) + f" no {i}.\n" for i in range(400)]
    texts = ["".join(lines[i : i + 60]) for i in range(0, 400, 60)] + ["".join(lines[30:90]) + "\u6d77" * 3000, "\u6d77\u6c34" * 2500, None, ""]
    df = spark.createDataFrame([(k * 100 + i, t) for k in range(10) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    e = Encoding(df)
    coder = encoder(vocabulary())
    assert {x["doc_id"]: x["ids"] for x in e.ids.collect()} == {k * 100 + i: coder.encode_ordinary(t or "") for k in range(10) for i, t in enumerate(texts)}
    assert e.encoded.first()["n_bytes"] == chunk_reuse(df).first()["distinct_bytes"] <= sum(len((t or "").encode()) for t in texts)


def test_leaks(spark, monkeypatch):
    r = random.Random(3)
    vocab = list("abcdefgh")
    items = [(i, " ".join(r.choices(vocab, k=30))) for i in range(6)] + [(6, None), (7, "short one"), (8, "")]
    docs = []
    for i in range(60):
        w = r.choices(vocab + ["zz"], k=40)
        if i % 3 == 0:
            src = items[r.randrange(6)][1].split()
            a = r.randrange(18)
            w[5:5] = src[a : a + r.choice([11, 12, 13])]
        docs.append((i, ", ".join(w).upper()))
    docs += [(60, None), (61, ""), (None, items[0][1]), (62, items[0][1] + " " + items[0][1])]
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for k in range(max(len(words(t)) - 11, 0)) for i in runs.get(tuple(words(t)[k : k + 12]), ())}
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    Q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {tuple(x) for x in leaks(D, Q).collect()} == want
    whole = leaked_passages(D, Q).where("doc_id = 62 AND item_id = 0").collect()
    assert [(x["n_words"], x["first_word"]) for x in whole] == [(30, 0)]
    assert without_leaks(D, Q).count() == len(docs) - len({d for d, _ in want if d is not None})
    assert leaks(D, Q.limit(0)).count() == 0 and leaks(D.limit(0), Q).count() == 0
    # test items in several parts, past the same shards
    monkeypatch.setattr("seamark.llm.leaks.TEST_CHARS", 100)
    monkeypatch.setattr("seamark.llm.leaks.KEPT_BYTES", 500)
    assert {tuple(x) for x in leaks(D, Q).collect()} == want


def test_long_match_is_found_whole():
    text = " ".join(f"w{i}" for i in range(500))
    t = HeldOut([(1, "x " + text)], 12)
    assert t.search([words("y " + text + " z")]) == [(0, 0, 500, 1)]


def test_repeats_against_brute_force():
    random.seed(1)
    for _ in range(20):
        docs = [[random.choice("abc") for _ in range(random.choice([0, 1, 4, 5, 20, 40]))] for _ in range(6)]
        n, again, longest = repeats(docs)
        for d, a, top in zip(docs, again, longest):
            seen, cover, best = set(), set(), 0
            for i in range(len(d) - 4):
                if tuple(d[i : i + 5]) in seen:
                    cover.update(range(i, i + 5))
                seen.add(tuple(d[i : i + 5]))
            for i in range(len(d)):
                for j in range(i + 1, len(d)):
                    k = 0
                    while j + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
            assert a == len(cover) and top == (best if best >= 5 else 0)


def test_repetition(spark):
    rows = [(1, "a b c d e " * 6), (2, None), (3, ""), (4, "!!"), (5, " ".join(map(str, range(30)))), (None, "a b c d e " * 6), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(2))
    got = sorted((str(r["doc_id"]), r["n_words"], r["repeated_words"], r["longest_repeat"]) for r in repetition(df).collect())
    assert got == sorted([("1", 30, 25, 25), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 0, 0, 0), ("5", 30, 0, 0), ("None", 30, 25, 25), ("1", 1, 0, 0)])
    assert {r[0] for r in repetitive(df).collect()} == {1, None}
    assert repetition(df.limit(0)).count() == 0
