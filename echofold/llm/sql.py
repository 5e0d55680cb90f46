"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations

_UNITS = """units1 AS (
  SELECT unit_id, any_value(lower(trim(lang))) AS lang, any_value(sig_lines) AS sig_lines, any_value(batch_no) AS batch_no,
         any_value(list_sort(list_distinct(list_filter(coalesce(fingerprints, []), lambda x: x IS NOT NULL)))) AS fps
  FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id),
comp AS (SELECT * FROM units1 WHERE len(fps) > 0 AND sig_lines >= 5),
fp AS (SELECT unit_id, unnest(fps) AS f FROM comp)"""


def _overlaps(where: str) -> str:
    return f"""shared_by AS (
  SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS i FROM fp x JOIN fp y ON x.f = y.f AND x.unit_id < y.unit_id GROUP BY 1, 2),
sims AS (
  SELECT a, b, i / (len(ca.fps) + len(cb.fps) - i) AS s, ca.lang AS la, cb.lang AS lb, ca.batch_no AS ba, cb.batch_no AS bb
  FROM shared_by JOIN comp ca ON ca.unit_id = a JOIN comp cb ON cb.unit_id = b WHERE {where})"""


def _batches(last: int = 12) -> str:
    """Batch by batch: links of a unit to accepted units of earlier batches decide whether it is accepted."""
    ctes = [f"WITH {_UNITS}", _overlaps("i / (len(ca.fps) + len(cb.fps) - i) >= 0.85"),
            "links AS (SELECT a AS q, b AS o, s, ba AS qb, bb AS ob FROM sims UNION ALL SELECT b, a, s, bb, ba FROM sims)",
            "acc0 AS (SELECT unit_id FROM comp WHERE batch_no = 0)"]
    for n in range(1, last + 1):
        ctes.append(f"rej{n} AS (SELECT q, o, s FROM links WHERE qb = {n} AND ob < {n} AND o IN (SELECT unit_id FROM acc{n - 1}))")
        ctes.append(f"acc{n} AS (SELECT unit_id FROM acc{n - 1} UNION ALL SELECT unit_id FROM comp WHERE batch_no = {n} AND unit_id NOT IN (SELECT q FROM rej{n}))")
    late = " UNION ALL ".join(f"SELECT * FROM rej{n}" for n in range(9, last + 1))
    return ",\n".join(ctes) + f"\nSELECT q AS unit_id, o AS original_id FROM ({late}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, o) = 1"


_CLASSES = f"""WITH {_UNITS}, owned AS (SELECT unit_id, lang, fps, min(unit_id) OVER (PARTITION BY lang, fps) AS rep FROM comp WHERE lang IS NOT NULL),
rfp AS (SELECT unit_id, lang, unnest(fps) AS f FROM owned WHERE unit_id = rep),
shared AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS i FROM rfp x JOIN rfp y ON x.f = y.f AND x.lang = y.lang AND x.unit_id < y.unit_id GROUP BY 1, 2),
links AS (SELECT a, b, i / (len(ca.fps) + len(cb.fps) - i) AS similarity FROM shared JOIN owned ca ON ca.unit_id = a JOIN owned cb ON cb.unit_id = b WHERE i / (len(ca.fps) + len(cb.fps) - i) >= 0.8)"""

SQL = {
    "p1_class_links": f"{_CLASSES} SELECT a, b, round(similarity, 6) AS similarity FROM links",
    "p1_classes": f"""{_CLASSES}, degree AS (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM links UNION ALL SELECT b FROM links) GROUP BY rep)
SELECT unit_id, owned.rep AS "class", coalesce(n, 0) AS links FROM owned LEFT JOIN degree ON degree.rep = owned.rep""",
    "p1_found": f"WITH {_UNITS}, {_overlaps('ca.lang = cb.lang')} SELECT a, b FROM sims WHERE s >= 0.8",
    "p3_found": """WITH RECURSIVE whole AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
link AS (SELECT DISTINCT * FROM (SELECT a AS x, b AS y FROM whole UNION ALL SELECT b, a FROM whole)),
everyone AS (SELECT func FROM members WHERE func IS NOT NULL UNION SELECT x FROM link),
reach(func, g) AS (SELECT func, func FROM everyone UNION SELECT link.y, reach.g FROM reach JOIN link ON link.x = reach.func WHERE reach.g < link.y)
SELECT func, min(g) AS group_id FROM reach GROUP BY func""",
    "p4_found": f"""WITH {_UNITS}, n AS (SELECT count(*) AS n FROM units1 WHERE len(fps) > 0),
terms AS (SELECT f, count(*) AS c FROM (SELECT unnest(fps) AS f FROM units1) GROUP BY f)
SELECT f AS fingerprint, CASE WHEN c = 1 THEN 'rare' ELSE 'common' END AS verdict FROM terms, n WHERE c = 1 OR c > greatest(10, n // 200)""",
    "p4_counts": """WITH raw AS (SELECT unit_id, any_value(coalesce(fingerprints, [])) AS fps FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id), each AS (SELECT unit_id, unnest(fps) AS f FROM raw),
n AS (SELECT count(DISTINCT unit_id) AS n FROM each WHERE f IS NOT NULL), terms AS (SELECT f, count(*) AS c, count(DISTINCT unit_id) AS u FROM each WHERE f IS NOT NULL GROUP BY f)
SELECT f AS fingerprint, c AS occurrences, u AS units, CASE WHEN u = 1 THEN 'rare' WHEN u > greatest(10, n // 200) THEN 'common' END AS verdict FROM terms, n""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_found": _batches(),
}
