"""Queries that write tables in the text formats and read them again, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamark.operators import evaluate as E
from seamark.operators import graph as G
from seamark.session import shared_folder
from seamark.sources import trec as T
from seamark.sources.tables import table


def _file(lines: DataFrame, *order: str) -> str:
    """Path of one file of the lines (column value) in an order, for readers in which the last line wins."""
    path = shared_folder(lines.sparkSession)
    T.write_text(lines.coalesce(1).sortWithinPartitions(*order).select("value") if order else lines, path)
    return path


def _qrels(s, d) -> DataFrame:
    """Judgements as lines of four fields, with repeated ones and some of three fields."""
    q = table(s, d, "combined_qrel").where("query_id IS NOT NULL AND assessor_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL")
    short = F.col("grade") == 7  # impossible grades lose their field
    value = F.concat_ws(" ", "query_id", "assessor_id", "doc_id", F.when(~short, F.col("grade").cast("string")))
    return T.read_qrels(s, _file(q.select(value.alias("value"), "graded_at", "grade"), "graded_at", "grade", "value"))


def _run(s, d, user: str | None) -> DataFrame:
    run = E.best_run(table(s, d, "result_bm25")).withColumn("score", F.col("score").cast("decimal(18,6)"))
    path = _file(T.run_lines(run, user))
    return T.read_run(s, path, 2, 4) if user else T.read_run(s, path)


def _queries(s, d) -> DataFrame:
    q = table(s, d, "queries").where("query_id IS NOT NULL AND text IS NOT NULL")
    return T.read_queries(s, _file(q.select(F.concat("query_id", F.lit(".   "), "text").alias("value"))))


def _adjacency(s, d) -> DataFrame:
    nodes, edges = G.page_graph(table(s, d, "document"))
    path = _file(T.adjacency_lines(G.complete(nodes, G.inlinks(edges))))
    return T.read_adjacency(s, path)[1]


def _ids(s, d) -> DataFrame:
    return table(s, d, "document").where("id IS NOT NULL")


def _log(s, d, plain: bool) -> DataFrame:
    """Ids as a crawl log: url and score; every third is an https one."""
    url = F.when(F.pmod(F.length("id"), F.lit(3)) == 0, F.regexp_replace("id", "^http:", "https:")).otherwise(F.col("id"))
    return T.read_crawl_log(s, _file(_ids(s, d).select(F.concat_ws(" ", url, F.lit("1.5")).alias("value"))), plain)


def queries() -> dict:
    return {
        "read_qrels": _qrels,
        "read_run_4": lambda s, d: _run(s, d, None),
        "read_run_5": lambda s, d: _run(s, d, "team"),
        "read_queries": _queries,
        "read_adjacency": _adjacency,
        "read_corpus": lambda s, d: T.read_corpus(s, _file(_ids(s, d).select(F.concat(F.lit("  "), "id", F.lit(" ")).alias("value")))),
        "read_crawl_log": lambda s, d: _log(s, d, False),
        "read_foreign_log": lambda s, d: _log(s, d, True),
        "read_words": lambda s, d: T.read_words(s, _file(table(s, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("value"))), "UTF-8"),
        "qrel_lines": lambda s, d: T.qrel_lines(E.merge_assessors(*[E.panel_grades(table(s, d, "combined_qrel"), F.pmod(F.length("assessor_id"), F.lit(3)) == n) for n in (0, 1, 2)])),
        "score_lines": lambda s, d: T.score_lines(G.degrees(*G.page_graph(table(s, d, "document"))).withColumn("score", F.col("n_in") - F.col("n_out")), True),
    }


_PANEL = "(SELECT query_id, doc_id, max(grade) AS grade FROM combined_qrel WHERE grade IN (0, 1, 2) AND query_id IS NOT NULL AND doc_id IS NOT NULL AND length(assessor_id) % 3 = {} GROUP BY query_id, doc_id)"
_BEST = """(SELECT query_id, doc_id, max(grade)::DECIMAL(18, 6)::DOUBLE AS score FROM result_bm25
    WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL AND NOT isnan(grade) GROUP BY query_id, doc_id)"""
_EDGES = r"""(SELECT DISTINCT id AS src, CASE WHEN regexp_matches(bare, '^(?i)https?://') THEN 'http://' || regexp_replace(lower(regexp_extract(bare, '^[a-zA-Z]+://([^/?]*)', 1)), ':(80|443)$', '')
    || regexp_replace(bare, '^[a-zA-Z]+://[^/?]*', '') ELSE bare END AS dst FROM (SELECT id, split_part(link, '#', 1) AS bare FROM (SELECT id, unnest(outlinks) AS link FROM document WHERE id IS NOT NULL) WHERE link <> ''))"""


def oracle_sql() -> dict[str, str]:
    log = "SELECT DISTINCT CASE WHEN length(id) % 3 = 0 THEN regexp_replace(id, '^http:', 'https:') ELSE id END AS id FROM document WHERE id IS NOT NULL"
    return {
        "read_qrels": """SELECT query_id, assessor_id, doc_id, grade::INT AS grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, assessor_id, doc_id
            ORDER BY graded_at DESC NULLS LAST, grade DESC) AS nth FROM combined_qrel WHERE query_id IS NOT NULL AND assessor_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL AND grade <> 7) WHERE nth = 1""",
        "read_run_4": f"SELECT * FROM {_BEST}",
        "read_run_5": f"SELECT * FROM {_BEST}",
        "read_queries": "SELECT query_id, trim(text) AS text FROM queries WHERE query_id IS NOT NULL AND text IS NOT NULL",
        "read_adjacency": f"SELECT dst AS src, src AS dst FROM {_EDGES} WHERE dst IN (SELECT id FROM document)",
        "read_corpus": "SELECT DISTINCT id FROM document WHERE id IS NOT NULL",
        "read_crawl_log": log,
        "read_foreign_log": "SELECT DISTINCT replace(id, 'https', 'http') AS id FROM document WHERE id IS NOT NULL",
        "read_words": "SELECT DISTINCT trim(lang) AS word FROM documents WHERE trim(lang) <> ''",
        "qrel_lines": f"""SELECT a.query_id || ' ' || a.doc_id || ' ' || CASE WHEN b.grade IS NULL THEN greatest(a.grade, c.grade) WHEN a.grade = b.grade THEN a.grade
            WHEN c.grade IS NULL THEN greatest(a.grade, b.grade) WHEN a.grade = c.grade THEN a.grade ELSE greatest(a.grade, b.grade, c.grade) END AS value
            FROM {_PANEL.format(0)} a LEFT JOIN {_PANEL.format(1)} b USING (query_id, doc_id) LEFT JOIN {_PANEL.format(2)} c USING (query_id, doc_id)""",
        "score_lines": f"""WITH e AS MATERIALIZED {_EDGES}, n AS (SELECT DISTINCT id FROM document WHERE id IS NOT NULL), i AS (SELECT dst AS id, count(*) AS n_in FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS n_out FROM e GROUP BY src)
            SELECT id || chr(9) || (coalesce(n_in, 0) - coalesce(n_out, 0)) || chr(9) || 'inlinks ' || coalesce(n_in, 0) || chr(9) || 'outlinks ' || coalesce(n_out, 0) AS value FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)""",
    }
