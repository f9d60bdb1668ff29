"""Focused crawl over a static table of pages: a best-first frontier in batches.

Each round takes the best ``batch`` urls of the frontier, scores their links and merges them into the frontier.  Only urls
that are stored and allowed get there, so the others take no places.  A batch of one is the serial order; larger batches
see the scores of the round before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamark.functions.html import extract_text, is_page, page_links
from seamark.functions.urls import base_url, inlink_bump, link_score, url_keywords, url_relevance, useful_link
from seamark.session import cut_lineage, delete, forget, store

MOST = 40_100  # logged pages


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(base_url, rules): the rules of ``robots`` (base_url, body, the text of robots.txt) for an agent: path prefixes in order with whether they allow.

    The group of the agent counts, else that of all agents; a null or empty body has no rules.  One row of each host is read.
    """
    def read(body: str | None) -> list[dict]:
        groups: dict[str, list[dict]] = {}
        names: list[str] = []
        open_ = False  # a group's names are being listed
        for line in (body or "").splitlines():
            key, _, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent":
                names = [*names, value.lower()] if open_ else [value.lower()]
                open_ = True
            elif key in ("allow", "disallow"):
                open_ = False
                if value or key == "allow":
                    for name in names:
                        groups.setdefault(name, []).append({"path": value, "allow": key == "allow"})
        mine = next((groups[n] for n in groups if n != "*" and n in agent.lower()), None)
        return mine if mine is not None else groups.get("*", [])

    @F.pandas_udf("array<struct<path:string,allow:boolean>>")
    def rules(body: pd.Series) -> pd.Series:
        return body.map(read)

    return robots.where("base_url IS NOT NULL").groupBy("base_url").agg(F.max("body").alias("body")).select("base_url", rules("body").alias("rules"))


def robots_allowed(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages that may be visited by ``robots`` (base_url, status, allowed, and rules if there are any): 401 and 403 forbid all, other errors allow all, unknown hosts allow.

    Of a host's rules the first whose path begins the page's path decides; without one the flag does, and a null flag allows.
    """
    flag = F.coalesce("__allowed", F.lit(True))
    path = F.regexp_replace(F.col("id"), r"^[a-zA-Z][^:/?#]*://[^/?#]*", "")
    if "rules" in robots.columns:
        fits = F.filter("__rules", lambda r: F.when(path == "", F.lit("/")).otherwise(path).startswith(r["path"]))
        flag = F.coalesce(F.get(fits, F.lit(0))["allow"], flag)
    rule = F.when(F.col("__status").isin(401, 403), False).when(F.col("__status") >= 400, True).otherwise(flag)
    known = robots.select(F.col("base_url").alias("__base"), F.col("status").alias("__status"), F.col("allowed").alias("__allowed"), F.lit(True).alias("__known"), *([F.col("rules").alias("__rules")] if "rules" in robots.columns else []))
    joined = pages.withColumn("__base", base_url(F.col("id"))).join(known, "__base", "left")
    return joined.where(F.col("__known").isNull() | rule).select(*pages.columns)


def _raised(score, n_inlinks, new_links):
    """Score after ``new_links`` more inlinks; each adds as long as there are fewer than ten with it."""
    times = F.greatest(F.lit(0), F.least(new_links, 9 - n_inlinks))
    return F.when(times > 0, F.round(inlink_bump(score, F.lit(0)) + (times - 1) * 0.01, 2)).otherwise(score)


def _saved_rounds(spark, saved: str) -> list[int]:
    """Rounds that are stored whole, in order."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(saved)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    paths = [x.getPath() for x in fs.listStatus(folder)]
    return sorted(int(p.getName()[6:]) for p in paths if p.getName().startswith("round=") and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def crawl(links: DataFrame, seeds: DataFrame, rounds: int | None, batch: int, pages: DataFrame | None = None, robots: DataFrame | None = None, most: int = MOST, saved: str | None = None, open_until: int | None = None) -> DataFrame:
    """Crawl log (url, score, wave, turn) over ``links`` (src, dst) from ``seeds`` (url, score, wave).

    Ends with an empty frontier, ``most`` logged pages or, if given, after ``rounds``.  ``pages`` (id) are those that can be read and
    ``robots`` the rules of ``robots_allowed``; without them every url is read.  Pages and rules don't change, so they are applied once.  With ``saved``, a shared folder, the state of
    the last two rounds is kept there, and a crawl that was broken off goes on from it.  With ``open_until`` no new urls
    are taken up once so many pages are logged, known ones still rise.
    """
    links = links.where(useful_link(F.col("dst"))).select("src", "dst").distinct()
    start = seeds.select("url", F.col("score").cast("double").alias("score"), F.col("wave").cast("int").alias("wave"))
    if robots is not None:
        pages = robots_allowed(pages if pages is not None else links.select(F.col("src").alias("id")).union(links.select("dst")).union(start.select("url")), robots)
    if pages is not None:
        pages = cut_lineage(pages.select("id").distinct())
        links = links.join(pages.withColumnRenamed("id", "src"), "src", "left_semi").join(pages.withColumnRenamed("id", "dst"), "dst", "left_semi")
        start = start.join(pages.withColumnRenamed("id", "url"), "url", "left_semi")
    links = store(links)
    first = start.groupBy("url").agg(F.max("score").alias("score"), F.min("wave").alias("wave"))
    state = first.withColumns({"n_inlinks": F.lit(0).cast("long"), "turn": F.lit(None).cast("int")})
    turn = logged = 0
    if saved:
        done = _saved_rounds(links.sparkSession, saved)
        if done:
            turn = max(done)
            state = links.sparkSession.read.parquet(f"{saved}/round={turn}")
            logged = state.where("turn IS NOT NULL").count()
    state = cut_lineage(state)
    while logged < most and (rounds is None or turn < rounds):
        turn += 1
        taken = cut_lineage(state.where("turn IS NULL").orderBy(F.desc("score"), "url").limit(min(batch, most - logged)).select("url", "score", "wave"))
        n = taken.count()
        if not n:
            break
        logged += n
        parent = F.min_by(F.struct("score", "wave"), F.struct(-F.col("score"), F.col("src"))).alias("parent")  # the one whose turn is first
        found = links.join(F.broadcast(taken.withColumnRenamed("url", "src")), "src").groupBy(F.col("dst").alias("url")).agg(parent, F.count(F.lit(1)).alias("new_links"))
        now = F.broadcast(taken.select("url", F.lit(turn).alias("now")))  # at most ``batch`` rows
        merged = state.join(now, "url", "left").withColumn("turn", F.coalesce("turn", "now")).drop("now").join(found, "url", "left" if open_until is not None and logged >= open_until else "full")
        wave = F.coalesce(F.col("wave"), F.col("parent.wave") + 1)
        fresh = link_score(url_relevance(url_keywords(F.col("url"))), F.col("parent.score"), wave)
        score = (
            F.when(F.col("score").isNull(), _raised(fresh, F.lit(1), F.col("new_links") - 1))
            .when(F.col("turn").isNull() & F.col("new_links").isNotNull(), _raised(F.col("score"), F.col("n_inlinks"), F.col("new_links")))
            .otherwise(F.col("score"))
        )
        n_inlinks = F.coalesce("n_inlinks", F.lit(0)) + F.coalesce("new_links", F.lit(0))
        state = cut_lineage(merged.select("url", score.alias("score"), wave.cast("int").alias("wave"), n_inlinks.alias("n_inlinks"), "turn"), state)
        forget(taken)
        if saved:
            state.write.mode("overwrite").parquet(f"{saved}/round={turn}")
            for old in _saved_rounds(state.sparkSession, saved)[:-2]:
                delete(state.sparkSession, f"{saved}/round={old}")
    return state.where("turn IS NOT NULL").select("url", "score", "wave", "turn")


def read_pages(pages: DataFrame, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a crawler takes from stored pages (id, headers, raw_html, one row per id): readable pages (id, title, text) and their links (src, dst).

    Readable are those that the robots rules allow and that are pages by their content type; links are the distinct anchors in canonical
    form, useful or not.
    """
    there = pages.where(is_page(F.col("headers")) & F.col("raw_html").isNotNull())
    there = robots_allowed(there, robots) if robots is not None else there
    links = page_links(there).select(F.col("id").alias("src"), F.col("target").alias("dst"))
    return extract_text(there), links


def crawl_stored(pages: DataFrame, seeds: DataFrame, batch: int, robots: DataFrame | None = None, most: int = MOST, open_until: int | None = 10_000, saved: str | None = None) -> DataFrame:
    """Crawl log over stored pages from their HTML on: content types, robots rules, links, scores, and the limits of the serial crawler."""
    there = pages.where(is_page(F.col("headers")) & F.col("raw_html").isNotNull())
    links = page_links(there).select(F.col("id").alias("src"), F.col("target").alias("dst"))
    return crawl(links, seeds, None, batch, there.select("id"), robots, most, saved, open_until)
