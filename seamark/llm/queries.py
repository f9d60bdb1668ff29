"""Queries of the subpackage and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.llm.boilerplate import frame_lines, main_text
from seamark.llm.consensus import Consensus
from seamark.llm.leaks import leaked_passages, leaks, without_leaks
from seamark.llm.neardup import NearDuplicates
from seamark.llm.repetition import repetition, repetitive
from seamark.llm.spam import page_evidence, spam_pages
from seamark.llm.tokens import chunk_reuse, token_ids
from seamark.llm.topn import top_n
from seamark.sources.tables import table


def queries() -> dict:
    return {
        "p1_found": lambda s, d: frame_lines(table(s, d, "document")),
        "p1_main_text": lambda s, d: main_text(table(s, d, "document")),
        "p2_found": lambda s, d: Consensus(table(s, d, "combined_qrel")).items.select("query_id", "doc_id", "grade"),
        "p2_annotators": lambda s, d: Consensus(table(s, d, "combined_qrel")).annotators.withColumns({c: F.round(c, 6) for c in ("reliability", "low", "high")}),
        "p2_agreement": lambda s, d: Consensus(table(s, d, "combined_qrel"), rounds=0).agreement.withColumns({c: F.round(c, 9) for c in ("alpha", "alpha_ordinal")}),
        "p4_found": lambda s, d: NearDuplicates(table(s, d, "document")).key_pairs(),
        "p4_class_pairs": lambda s, d: NearDuplicates(table(s, d, "document")).pairs.withColumn("similarity", F.round("similarity", 9)),
        "p4_classes": lambda s, d: NearDuplicates(table(s, d, "document")).classes(),
        "p6_found": lambda s, d: spam_pages(table(s, d, "document")),
        "p6_page_evidence": lambda s, d: page_evidence(table(s, d, "document")),
        "p7_found": lambda s, d: top_n(table(s, d, "result_bm25"), "query_id", "doc_id", "grade", 10).select("query_id", "doc_id"),
        "p7_top_items": lambda s, d: top_n(table(s, d, "result_bm25"), "query_id", "doc_id", "grade", 10),
        "p8_ids": lambda s, d: token_ids(table(s, d, "documents")),
        "p8_chunk_reuse": lambda s, d: chunk_reuse(table(s, d, "documents")),
        "p9_found": lambda s, d: leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_passages": lambda s, d: leaked_passages(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_clean_documents": lambda s, d: without_leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id"),
        "p10_found": lambda s, d: repetitive(table(s, d, "documents")),
        "p10_repetition": lambda s, d: repetition(table(s, d, "documents")),
    }


def _psi(x: str) -> str:
    """Digamma by the recurrence psi(x) = psi(x + 6) - 1/x - ... - 1/(x + 5) and the asymptotic series."""
    y = f"({x} + 6.0::DOUBLE)"
    series = " ".join(f"{sign} 1.0::DOUBLE / ({k} * pow({y}, {n}))" for sign, k, n in (("-", 12, 2), ("+", 120, 4), ("-", 252, 6), ("+", 240, 8), ("-", 132, 10)))
    return f"(ln({y}) - 0.5::DOUBLE / {y} {series} - (" + " + ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(6)) + "))"


def _consensus_sql(rounds: int = 12) -> str:
    """The variational model over grades 0, 1, 2, unrolled; it ends with the first round that moves no reliability by more than 0.001 (the fifth at sf0.01)."""
    k, cells = (0, 1, 2), [(j, g) for j in (0, 1, 2) for g in (0, 1, 2)]
    count = ", ".join(f"sum(CASE WHEN grade = {g} THEN q{j} ELSE 0 END) AS n{j}{g}" for j, g in cells) + ", " + ", ".join(f"sum(q{j} / m) AS p{j}" for j in k)
    right, votes = "n00 + n11 + n22", " + ".join(f"n{j}{g}" for j, g in cells)
    out = [f"""WITH v AS MATERIALIZED (SELECT query_id, doc_id, assessor_id, grade FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, assessor_id ORDER BY graded_at DESC NULLS LAST, grade DESC) AS n
            FROM combined_qrel WHERE grade IN (0, 1, 2) AND query_id IS NOT NULL AND assessor_id IS NOT NULL AND doc_id IS NOT NULL) WHERE n = 1),
        sz AS MATERIALIZED (SELECT query_id, doc_id, count(*) AS m, {", ".join(f"avg((grade = {j})::INT) AS q{j}" for j in k)} FROM v GROUP BY ALL),
        t0 AS MATERIALIZED (SELECT assessor_id, {count} FROM v JOIN sz USING (query_id, doc_id) GROUP BY assessor_id)"""]
    for i in range(1, rounds + 1):
        whole = " + ".join(f"sum(p{j}) + 1" for j in k)
        alpha = {j: [f"(n{j}{g} + {2 if j == g else 1})" for g in k] for j in k}
        logs = ", ".join(f"{_psi(alpha[j][g])} - {_psi('(' + ' + '.join(alpha[j]) + ')')} AS l{j}{g}" for j, g in cells)
        pick = lambda j: f"CASE grade WHEN 0 THEN l{j}0 WHEN 1 THEN l{j}1 ELSE l{j}2 END"
        out.append(f"""c{i} AS MATERIALIZED (SELECT {", ".join(f"{_psi(f'(sum(p{j}) + 1)')} - {_psi(f'({whole})')} AS c{j}" for j in k)} FROM t{i - 1}), l{i} AS MATERIALIZED (SELECT assessor_id, {logs} FROM t{i - 1}),
            z{i} AS MATERIALIZED (SELECT query_id, doc_id, count(*) AS m, {", ".join(f"any_value(c{j}) + sum({pick(j)}) AS z{j}" for j in k)} FROM v JOIN l{i} USING (assessor_id), c{i} GROUP BY query_id, doc_id),
            q{i} AS MATERIALIZED (SELECT query_id, doc_id, m, {", ".join(f"exp(z{j} - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) AS q{j}" for j in k)} FROM z{i}),
            t{i} AS MATERIALIZED (SELECT assessor_id, {count} FROM v JOIN q{i} USING (query_id, doc_id) GROUP BY assessor_id)""")
    moved = " UNION ALL ".join(f"SELECT {i} AS turn, max(abs((a.r + 2) / (a.n + 4) - (b.r + 2) / (b.n + 4))) AS moved FROM w a JOIN w b USING (assessor_id) WHERE a.turn = {i} AND b.turn = {i - 1}" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS turn, assessor_id, {right} AS r, {votes} AS n FROM t{i}" for i in range(rounds + 1))
    return ", ".join(out) + f""", w AS MATERIALIZED ({every}), stop AS MATERIALIZED (SELECT min(turn) AS turn FROM ({moved}) WHERE moved <= 0.001),
        who AS MATERIALIZED (SELECT assessor_id, round(n)::BIGINT AS n_votes, (r + 2) / (n + 4) AS reliability, 1.96::DOUBLE * sqrt((r + 2) / (n + 4) * (1 - (r + 2) / (n + 4)) / (n + 5)) AS dev FROM w JOIN stop USING (turn))"""


def _items_sql(rounds: int = 12) -> str:
    """Grades of most reliable annotators; the posterior of one round more settles ties, and the smaller grade does where they are equal."""
    post = " UNION ALL ".join(f"SELECT {i} AS turn, query_id, doc_id, q0, q1, q2 FROM q{i}" for i in range(1, rounds + 1))
    return f"""{_consensus_sql(rounds)}, q AS (SELECT * FROM ({post}) p JOIN stop ON p.turn = stop.turn + 1),
        g AS (SELECT query_id, doc_id, {", ".join(f"count(*) FILTER (grade = {j} AND reliability >= 0.6) AS v{j}" for j in (0, 1, 2))} FROM v JOIN who USING (assessor_id) GROUP BY query_id, doc_id),
        o AS (SELECT query_id, doc_id, unnest([{{'v': v0, 'q': q0, 'g': 0}}, {{'v': v1, 'q': q1, 'g': 1}}, {{'v': v2, 'q': q2, 'g': 2}}]) AS x FROM g JOIN q USING (query_id, doc_id))
        SELECT query_id, doc_id, x.g::INT AS grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY x.v DESC, x.q DESC, x.g) AS nth FROM o) WHERE nth = 1"""


_TOP = """SELECT query_id, doc_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id)::INT AS rank FROM (
    SELECT query_id, doc_id, max(grade) AS grade FROM result_bm25
    WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL AND NOT isnan(grade) GROUP BY query_id, doc_id)"""
_RUNS = r"""
    WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
    r AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS pos, ws FROM l WHERE len(ws) >= 5),
    n AS (SELECT doc_id, pos, ws[pos + 1:pos + 5] AS run, row_number() OVER (PARTITION BY doc_id, ws[pos + 1:pos + 5] ORDER BY pos) AS nth FROM r),
    c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 5)) AS w FROM n WHERE nth > 1),
    s AS (SELECT doc_id, count(*) AS repeated FROM c GROUP BY doc_id)"""
# repeats of one distance in a row are one longer repeat
_REPETITION = """, q AS (SELECT a.doc_id, a.pos, b.pos - a.pos AS far FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.run = b.run),
    i AS (SELECT doc_id, far, pos - row_number() OVER (PARTITION BY doc_id, far ORDER BY pos) AS island FROM q),
    g AS (SELECT doc_id, max(k) + 4 AS longest FROM (SELECT doc_id, count(*) AS k FROM i GROUP BY doc_id, far, island) GROUP BY doc_id)
    SELECT l.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(repeated, 0)::BIGINT AS repeated_words, CASE WHEN len(ws) > 0 THEN coalesce(repeated, 0) / len(ws) ELSE 0 END::DOUBLE AS repeated_share,
        coalesce(longest, 0)::BIGINT AS longest_repeat FROM l LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)"""
_LONGEST = """, ip AS (SELECT item_id, ws[pos + 1:pos + 12] AS run, pos AS a FROM (SELECT item_id, ws, unnest(range(len(ws) - 11)) AS pos FROM i WHERE len(ws) >= 12)),
    dp AS (SELECT doc_id, ws[pos + 1:pos + 12] AS run, pos AS b FROM (SELECT doc_id, ws, unnest(range(len(ws) - 11)) AS pos FROM d WHERE len(ws) >= 12)),
    q AS (SELECT doc_id, item_id, b, b - a AS far, b - row_number() OVER (PARTITION BY doc_id, item_id, b - a ORDER BY b) AS island FROM ip JOIN dp USING (run)),
    g AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(b) AS first_word FROM q GROUP BY doc_id, item_id, far, island)
    SELECT doc_id, item_id, n_words::INT AS n_words, first_word::INT AS first_word FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, first_word) AS nth FROM g) WHERE nth = 1"""
_PASSAGES = r"""
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items),
    ir AS (SELECT DISTINCT item_id, ws[pos + 1:pos + 12] AS run FROM (SELECT item_id, ws, unnest(range(len(ws) - 11)) AS pos FROM i WHERE len(ws) >= 12)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
    dr AS (SELECT DISTINCT doc_id, ws[pos + 1:pos + 12] AS run FROM (SELECT doc_id, ws, unnest(range(len(ws) - 11)) AS pos FROM d WHERE len(ws) >= 12)),
    f AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run))"""


_SHINGLES = r"""
    WITH t AS (SELECT DISTINCT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM document WHERE id IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT text, min(id) AS rep, count(*) AS size FROM t GROUP BY text),
    r AS MATERIALIZED (SELECT DISTINCT rep, ws[k:k + 2] AS run FROM (SELECT rep, ws, unnest(range(1, len(ws) - 1)) AS k FROM (SELECT DISTINCT rep, ws FROM c JOIN t USING (text)) WHERE len(ws) >= 3)),
    n AS (SELECT rep, count(*) AS n FROM r GROUP BY rep),
    p AS MATERIALIZED (SELECT x.rep AS rep_a, y.rep AS rep_b, count(*) AS held FROM r x JOIN r y ON x.run = y.run AND x.rep < y.rep GROUP BY 1, 2),
    s AS MATERIALIZED (SELECT rep_a, rep_b, held / (a.n + b.n - held) AS similarity FROM p JOIN n a ON a.rep = rep_a JOIN n b ON b.rep = rep_b WHERE 2 * held >= a.n + b.n - held),
    m AS MATERIALIZED (SELECT DISTINCT id AS key, rep, size FROM t JOIN c USING (text))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_class_pairs": f"{_SHINGLES} SELECT rep_a, rep_b, round(similarity, 9) AS similarity FROM s",
        "p4_classes": f"""{_SHINGLES} SELECT key, rep, coalesce(l.n, 0)::BIGINT AS n_links FROM m LEFT JOIN (
            SELECT rep, count(*) AS n FROM (SELECT rep_a AS rep FROM s UNION ALL SELECT rep_b FROM s) GROUP BY rep) l USING (rep)""",
        "p4_found": f"""{_SHINGLES}, f AS (SELECT key, rep, size FROM m WHERE rep IN (SELECT rep FROM n)), w AS (SELECT key, rep FROM f WHERE size <= 64 OR key = rep),
            e AS (SELECT a.key AS x, b.key AS y FROM s JOIN w a ON a.rep = rep_a JOIN w b ON b.rep = rep_b
                UNION SELECT a.key, b.key FROM f a JOIN f b ON a.rep = b.rep AND a.key < b.key WHERE a.size <= 64 OR a.key = a.rep)
            SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM e WHERE x <> y""",
        "p2_agreement": """
            WITH v AS (SELECT query_id, doc_id, assessor_id, grade FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, assessor_id ORDER BY graded_at DESC NULLS LAST, grade DESC) AS n
                FROM combined_qrel WHERE grade IN (0, 1, 2) AND query_id IS NOT NULL AND assessor_id IS NOT NULL AND doc_id IS NOT NULL) WHERE n = 1),
            i AS (SELECT query_id, doc_id, count(*) AS m, count(*) FILTER (grade = 0) AS a, count(*) FILTER (grade = 1) AS b,
                count(*) FILTER (grade = 2) AS c FROM v GROUP BY query_id, doc_id HAVING count(*) >= 2),
            s AS (SELECT count(*) AS n_items, sum(m)::BIGINT AS n_pairable, sum((a * (m - a) + b * (m - b) + c * (m - c)) / (m - 1)) AS seen,
                sum(a * b / (m - 1)) AS ab, sum(b * c / (m - 1)) AS bc, sum(a * c / (m - 1)) AS ac,
                sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(c)::DOUBLE AS c FROM i)
            SELECT n_items, n_pairable, round(1 - seen * (n_pairable - 1) / (a * (n_pairable - a) + b * (n_pairable - b) + c * (n_pairable - c)), 9) AS alpha,
                round(1 - (ab * x * x + bc * y * y + ac * z * z) * (n_pairable - 1) / (a * b * x * x + b * c * y * y + a * c * z * z), 9) AS alpha_ordinal
            FROM (SELECT *, (a + b) / 2 AS x, (b + c) / 2 AS y, a / 2 + b + c / 2 AS z FROM s)""",
        "p2_annotators": f"""{_consensus_sql()} SELECT assessor_id, n_votes, round(reliability, 6) AS reliability, round(greatest(reliability - dev, 0), 6) AS low, round(least(reliability + dev, 1), 6) AS high,
            reliability >= 0.6 AS reliable FROM who""",
        "p2_found": _items_sql(),
        "p7_found": f"SELECT query_id, doc_id FROM ({_TOP}) WHERE rank <= 10",
        "p7_top_items": f"SELECT * FROM ({_TOP}) WHERE rank <= 10",
        "p9_found": f"{_PASSAGES} SELECT doc_id, item_id FROM f",
        "p9_clean_documents": f"{_PASSAGES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
        "p9_passages": f"{_PASSAGES} {_LONGEST}",
        "p10_repetition": f"{_RUNS} {_REPETITION}",
        "p10_found": f"{_RUNS} SELECT doc_id FROM s JOIN l USING (doc_id) WHERE len(ws) >= 20 AND 10 * repeated >= 3 * len(ws)",
    }
