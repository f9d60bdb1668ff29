"""Queries and SQL of the general data problems."""

from __future__ import annotations

from seamark.operators.heavy_keys import dominant_link_sources, link_source_load
from seamark.operators.orphans import orphan_references, orphan_report
from seamark.sources.tables import table


def queries() -> dict:
    return {
        "p3_found": lambda s, d: dominant_link_sources(table(s, d, "document")),
        "p3_link_source_load": lambda s, d: link_source_load(table(s, d, "document")).result,
        "p5_found": lambda s, d: orphan_references(table(s, d, "document"), table(s, d, "crawl_seed")),
        "p5_orphan_report": lambda s, d: orphan_report(table(s, d, "document"), table(s, d, "crawl_seed")),
    }


_ENTRIES = "SELECT id, unnest(inlinks) AS link_source FROM document"
_ORPHANS = r"""
newest AS (
  SELECT id, max(coalesce(fetched_at, TIMESTAMP '0001-01-01')) AS t FROM document WHERE id IS NOT NULL GROUP BY id
), known AS (
  SELECT d.id AS url FROM document d JOIN newest n ON d.id = n.id AND coalesce(d.fetched_at, TIMESTAMP '0001-01-01') = n.t
  WHERE coalesce(d.http_status NOT IN (404, 410), true)
  UNION SELECT url FROM crawl_seed
), links AS (
  SELECT id, 'outlinks' AS link_field, unnest(outlinks) AS link_target, fetched_at FROM document
  UNION ALL SELECT id, 'inlinks', unnest(inlinks), fetched_at FROM document
), refs AS (
  SELECT DISTINCT id, link_field, link_target, coalesce(strftime(fetched_at, '%Y-%m'), 'unknown') AS ref_period,
         split_part(link_target, '#', 1) AS bare
  FROM links WHERE link_target <> ''
), canonical AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^(?i)https?://') THEN
           'http://' || regexp_replace(lower(regexp_extract(bare, '^[a-zA-Z]+://([^/?]*)', 1)), ':(80|443)$', '')
           || regexp_replace(bare, '^[a-zA-Z]+://[^/?]*', '') ELSE bare END AS target
  FROM refs
), orphans AS (
  SELECT id, link_field, link_target, ref_period FROM canonical
  WHERE regexp_matches(target, '^[a-zA-Z]+://[^/?]*/') AND target NOT IN (SELECT url FROM known WHERE url IS NOT NULL)
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH e AS ({_ENTRIES}) SELECT link_source FROM e WHERE link_source <> '' GROUP BY link_source
            HAVING count(*) >= 0.05 * (SELECT count(*) FROM e WHERE link_source <> '')""",
        "p3_link_source_load": f"""WITH e AS ({_ENTRIES}) SELECT link_source, count(*) AS n_entries, count(DISTINCT id) AS n_pages
            FROM e WHERE link_source <> '' GROUP BY link_source""",
        "p5_found": f"WITH {_ORPHANS} SELECT * FROM orphans",
        "p5_orphan_report": f"""WITH {_ORPHANS} SELECT link_field, ref_period, count(*) AS n_orphans, count(DISTINCT id) AS n_pages,
            count(DISTINCT link_target) AS n_targets FROM orphans GROUP BY link_field, ref_period""",
    }
