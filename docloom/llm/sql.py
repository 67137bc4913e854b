"""DuckDB SQL for the contract queries that SQL can express on whole tables."""

from __future__ import annotations

_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS run FROM g),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS again FROM k),
c AS (SELECT w.*, coalesce(max(again) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.i = r.p),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS run
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.run = iw.run),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": _SUBSTRINGS, "op6_decontamination": _DECONTAMINATION}
