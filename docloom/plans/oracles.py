"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_NL = "chr(10)"
_SPACE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)||chr(65279)"

_SNIFF = f"""
  CASE WHEN octet_length(encode(left(t, 16))) >= 4 AND starts_with(t, '%PDF') THEN 'pdf'
       WHEN octet_length(encode(left(t, 16))) >= 4 AND (starts_with(t, 'GIF8') OR (starts_with(t, 'RIFF') AND substring(t, 9, 4) = 'WEBP') OR starts_with(t, 'BM')) THEN 'image'
       WHEN coalesce(t, '') = '' THEN 'text'
       WHEN starts_with(s, '<!DOCTYPE') OR starts_with(s, '<html') OR starts_with(s, '<HTML') THEN 'html'
       WHEN regexp_matches(left(s, 500), '(?m)^(?:From|To|Subject|Date|MIME-Version|Content-Type):\\s') THEN 'email'
       WHEN regexp_matches(left(s, 2000), '(?m)^#{{1,6}}\\s') THEN 'markdown'
       WHEN len(l) >= 2 AND ((c[1] > 0 AND list_min(c) = c[1] AND list_max(c) = c[1]) OR (b[1] > 0 AND list_min(b) = b[1] AND list_max(b) = b[1])) THEN 'csv'
       ELSE 'text' END"""


def _sniffed(source: str) -> str:
    return f"""
  SELECT *, {_SNIFF} AS sniffed FROM (
    SELECT *, list_transform(l, lambda x: length(x) - length(replace(x, ',', ''))) AS c, list_transform(l, lambda x: length(x) - length(replace(x, chr(9), ''))) AS b FROM (
      SELECT *, string_split(s, {_NL})[1:5] AS l FROM (SELECT *, ltrim(t, {_SPACE}) AS s FROM ({source}))))"""


def _looked_up(value: str, table: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(repr(x) for x in names)}) THEN '{kind}'" for kind, names in table.items()) + " END"


def _names() -> str:
    from ..operators.detect import BY_EXTENSION, BY_MIME

    ends = "['pdf','PNG','tsv','htm','xls','docx','msg','md','zip','']"
    mimes = "['text/html; charset=utf-8','APPLICATION/PDF','image/webp','message/rfc822','text/unknown']"
    source = f"""SELECT p_partkey AS doc_id, p_name AS t, p_name || '.' || {ends}[(p_partkey % 10 + 1)::INT] AS f,
      CASE WHEN p_partkey % 3 = 0 THEN {mimes}[(p_partkey % 5 + 1)::INT] END AS m,
      CASE WHEN p_partkey % 7 = 0 THEN 'markdown' WHEN p_partkey % 11 = 0 THEN 'auto' END AS h FROM part"""
    mime = _looked_up("trim(split_part(lower(m), ';', 1))", BY_MIME)
    name = _looked_up("regexp_extract(lower(f), '\\.([^.]*)$', 1)", BY_EXTENSION)
    return f"SELECT doc_id, coalesce(CASE WHEN h <> 'auto' THEN h END, {mime}, {name}, sniffed) AS format FROM ({_sniffed(source)})"


_TURNS = "SELECT conv_id AS doc_id, turn, role, text FROM conversations"
_MARKDOWN = f"SELECT conv_id AS doc_id, string_agg('# ' || role || ' ' || turn || {_NL} || text, {_NL} ORDER BY turn) AS text FROM conversations GROUP BY 1"
_PASS = """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total,
  text, '' AS context, 0::BIGINT AS char_offset FROM conversations"""


def _numbered(chunks: str, window: int) -> str:
    return f"""SELECT doc_id, c AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total, text,
  coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY c), {window}), '') AS context, char_offset FROM ({chunks})"""


def _packed(lines: str, most: int, head: int = 0) -> str:
    """Lines (doc_id, i from 1, line) packed in order; c: number of the piece, off: its offset.

    ``head`` is the cost of the head that every piece but the first opens with again; the first
    line's cost must include it."""
    over = f"r.cost + length(l.line) + 1 > {most}"
    return f"""WITH RECURSIVE l AS MATERIALIZED ({lines}),
r AS (SELECT doc_id, i, line, 0::BIGINT AS c, ({head} + length(line) + 1)::BIGINT AS cost, 0::BIGINT AS off FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.line, CASE WHEN {over} THEN r.c + 1 ELSE r.c END,
    CASE WHEN {over} THEN {head} + length(l.line) + 1 ELSE r.cost + length(l.line) + 1 END,
    CASE WHEN {over} THEN r.off + r.cost ELSE r.off END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)"""


_HEAD = "| o_orderkey | o_orderstatus | o_orderpriority |\n| --- | --- | --- |"
_ORDER_LINES = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line FROM orders"
_HEAD_SQL = " || chr(10) || ".join(repr(x) for x in _HEAD.split("\n"))
_ORDER_TEXT = f"SELECT doc_id, {_HEAD_SQL} || {_NL} || string_agg(line, {_NL} ORDER BY i) AS text FROM ({_ORDER_LINES}) GROUP BY 1"

_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem"
_SEP = "chr(10)||chr(10)||'---'||chr(10)||chr(10)"
_ITEM = "l_partkey || ':' || l_returnflag || ':' || l_linenumber"


def _merged(items: str) -> str:
    return f"""SELECT l_orderkey AS doc_id, string_agg(l_returnflag, {_SEP} ORDER BY k) AS flag,
  coalesce(arg_min(l_partkey, k) FILTER (l_linenumber % 2 = 0), -1) AS number, {items} AS items,
  string_agg(l_linestatus, {_SEP} ORDER BY k) AS status, arg_min(l_linenumber > 2, k) AS late FROM ({_LINES}) GROUP BY 1"""


def _deduped(value: str) -> str:
    return f"""WITH x AS ({_LINES}), g AS (SELECT l_orderkey, l_returnflag, min(k) AS first, arg_min({_ITEM}, k) AS head, arg_max({_ITEM}, k) AS last FROM x GROUP BY 1, 2),
d AS (SELECT l_orderkey, string_agg({value}, ',' ORDER BY first) AS items FROM g GROUP BY 1),
m AS ({_merged("''")})
SELECT m.* EXCLUDE (items), d.items FROM m JOIN d ON m.doc_id = d.l_orderkey"""


_WINDOWS = """SELECT doc_id, text, k, greatest(0, ceil((length(text) - 1000) / 800.0))::BIGINT + 1 AS total FROM
  (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 800.0))::BIGINT + 1)) AS k FROM documents WHERE length(text) > 0)"""


def oracle_sql() -> dict[str, str]:
    cells = "'| ' || {0} || ' |'"
    return {
        "detect_documents": f"SELECT sniffed AS format, count(*) AS n_docs, sum(id)::BIGINT AS sum_ids FROM ({_sniffed('SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT page_id + 1000000000, html FROM pages')}) GROUP BY 1",
        "detect_names": _names(),
        "chunk_sliding": f"""SELECT doc_id, k AS chunk_index, total, substring(text, k * 800 + 1, 1000) AS text,
  CASE WHEN k > 0 THEN substring(text, k * 800 - 199, 200) ELSE '' END AS context, k * 800 AS char_offset FROM ({_WINDOWS})""",
        "chunk_none": _PASS,
        "chunk_page": _PASS,
        "chunk_row": _packed(f"SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents", 1000)
        + _numbered(f"SELECT doc_id, c, string_agg(line, {_NL} ORDER BY i) AS text, min(off) AS char_offset FROM r GROUP BY 1, 2", 100),
        "chunk_row_tables": _packed(_ORDER_LINES, 200, len(_HEAD) + 1) + _numbered(f"SELECT doc_id, c, {_HEAD_SQL} || {_NL} || string_agg(line, {_NL} ORDER BY i) AS text, min(off) AS char_offset FROM r GROUP BY 1, 2", 50),
        "chunk_structural": f"SELECT doc_id, 0::BIGINT AS chunk_index, 1::BIGINT AS total, text, '' AS context, 0::BIGINT AS char_offset FROM ({_MARKDOWN})",
        "chunk_structural_packed": _packed(f"SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, '# ' || role || ' ' || turn || {_NL} || text AS line FROM conversations", 4000)
        + _numbered(f"SELECT doc_id, c, string_agg(line, {_NL} ORDER BY i) AS text, min(off) AS char_offset FROM r GROUP BY 1, 2", 60),
        "sentence_slices": "SELECT doc_id, true AS exact, length(regexp_replace(text, '\\s', '', 'g')) AS n_signs, true AS bounded FROM documents WHERE regexp_matches(text, '\\S')",
        "auto_choice": f"""SELECT doc_id, CASE WHEN length(text) <= 8000 THEN 'none' WHEN regexp_matches(left(text, 10000), '(?m)^\\|.+\\|$') THEN 'row'
  WHEN regexp_matches(left(text, 10000), '(?m)^#{{1,6}}\\s') THEN 'structural' ELSE 'sentence' END AS strategy
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text || {_NL} || repeat('x', 9000) FROM ({_ORDER_TEXT}))""",
        "chunk_context": f"SELECT doc_id, row_number() OVER w - 1 AS chunk_index, coalesce(right(lag(text) OVER w, 40), '') AS context FROM ({_TURNS}) WINDOW w AS (PARTITION BY doc_id ORDER BY turn)",
        "chunk_custom": f"""SELECT doc_id, 2 * n + k AS chunk_index, 0::BIGINT AS total, CASE WHEN k = 0 THEN left(text, length(text) // 2) ELSE substring(text, length(text) // 2 + 1) END AS text,
  '' AS context, k * (length(text) // 2) AS char_offset FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS n FROM ({_TURNS})), (SELECT unnest([0, 1])::BIGINT AS k)""",
        "normalize_text": "SELECT doc_id, coalesce(text, '') AS text, 'text' AS format, false AS is_visual FROM documents",
        "csv_native": f"""SELECT 'nation' AS name, '| n_nationkey | n_name | n_regionkey |' || {_NL} || '| --- | --- | --- |' || {_NL} || string_agg({cells.format("n_nationkey || ' | ' || n_name || ' | ' || n_regionkey")}, {_NL} ORDER BY n_nationkey) AS text FROM nation
  UNION ALL SELECT 'region', '| r_regionkey | r_name |' || {_NL} || '| --- | --- |' || {_NL} || string_agg({cells.format("r_regionkey || ' | ' || r_name")}, {_NL} ORDER BY r_regionkey) FROM region""",
        "csv_parsed": f"SELECT c_nationkey::BIGINT AS doc_id, '| key | name | segment |' || {_NL} || '| --- | --- | --- |' || {_NL} || string_agg({cells.format("c_custkey || ' | ' || c_name || ' | ' || c_mktsegment")}, {_NL} ORDER BY c_custkey) AS text FROM customer GROUP BY 1",
        "html_tables": f"""SELECT n_regionkey::BIGINT AS doc_id, 'Nations' || {_NL} || {_NL} || rpad('key', w, ' ') || '   name' || {_NL} || string_agg(rpad(n_nationkey::VARCHAR, w, ' ') || '   ' || n_name, {_NL} ORDER BY n_nationkey) AS text
  FROM (SELECT *, greatest(3, max(length(n_nationkey::VARCHAR)) OVER (PARTITION BY n_regionkey))::INT AS w FROM nation) GROUP BY n_regionkey, w""",
        "email_text": f"""SELECT conv_id * 1000 + turn AS doc_id, 'From: ' || role || '@example.com' || {_NL} || 'To: a@example.com, b@example.com' || {_NL} || 'Subject: turn ' || turn || {_NL} ||
  'Date: 2024-01-01T08:00:00.000Z' || {_NL} || {_NL} || regexp_replace(text, '[\\r\\n]+', ' ', 'g') || {_NL} AS text FROM conversations""",
        "xlsx_sheets": f"""SELECT n_regionkey::BIGINT AS doc_id, 0::BIGINT AS block_index, 'nations' AS sheet, '| key | name |' || {_NL} || '| --- | --- |' || {_NL} || string_agg({cells.format("n_nationkey || ' | ' || n_name")}, {_NL} ORDER BY n_nationkey) AS text FROM nation GROUP BY 1
  UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 1, 'empty', '' FROM nation""",
        "docx_markdown": f"SELECT s_nationkey::BIGINT AS doc_id, '## Nation ' || s_nationkey || {_NL} || {_NL} || string_agg('- __' || regexp_replace(s_name, '([\\\\`*_{{}}\\[\\]()#+.!-])', '\\\\\\1', 'g') || '__', {_NL} ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey",
        "pdf_text": f"""SELECT doc_id, CASE WHEN length(t) > 50 THEN t ELSE 'scanned' END AS text, length(t) <= 50 AS is_visual, 'pdf' AS format
  FROM (SELECT min(p_partkey) AS doc_id, string_agg(p_name, {_NL} ORDER BY p_partkey) AS t FROM part GROUP BY p_brand, p_size)""",
        "image_ocr": "SELECT s_suppkey AS doc_id, (8 + octet_length(encode(s_name))) || ' bytes of unnamed (unknown)' AS text, true AS is_visual FROM supplier",
        "normalize_errors": "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS text, CASE WHEN s_suppkey % 2 = 0 THEN 'NormalizeError' ELSE '' END AS error, CASE WHEN s_suppkey % 2 = 0 THEN 'image' ELSE '' END AS format FROM supplier",
        "prompt_build": f"""SELECT doc_id, row_number() OVER w - 1 AS chunk_index, 'Find the facts.' || {_NL} || {_NL} || 'Examples:' || {_NL} || 'Q: a' || {_NL} || 'A: {{"b":1}}' || {_NL} ||
  coalesce({_NL} || {_NL} || '[Previous context]: ' || right(nullif(lag(text) OVER w, ''), 500), '') || {_NL} || {_NL} || '[Document]: ' || text || {_NL} || {_NL} || 'Extract the data according to the schema.' AS prompt
  FROM ({_TURNS}) WINDOW w AS (PARTITION BY doc_id ORDER BY turn)""",
        "schema_extract": """SELECT o_custkey AS doc_id, CASE WHEN s IN ('O', 'F') THEN s ELSE '' END AS status, CASE WHEN s IN ('O', 'F') THEN n ELSE 0 END AS n_orders, CASE WHEN s IN ('O', 'F') THEN n ELSE 0 END AS n_items,
  CASE WHEN s IN ('O', 'F') THEN '' ELSE 'status is none of O, F' END AS error FROM (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, count(*) AS n FROM orders GROUP BY 1)""",
        "error_policy": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS chunk_index, CASE WHEN length(text) % 3 = 0 THEN '' ELSE left(text, 10) END AS data,
  CASE WHEN length(text) % 3 = 0 THEN 'no answer' ELSE '' END AS error, CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_partials FROM ({_TURNS})""",
        "vision_extract": "SELECT s_suppkey AS doc_id, 'Size: ' || octet_length(encode(s_name)) || ' bytes' AS data, '[image input]' AS chunk_text, 'image' AS format FROM supplier",
        "merge_concat": _merged(f"string_agg({_ITEM}, ',' ORDER BY k)"),
        "merge_first": f"""SELECT l_orderkey AS doc_id, l_returnflag AS flag, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE -1 END AS number, {_ITEM} AS items, l_linestatus AS status, l_linenumber > 2 AS late FROM ({_LINES}) WHERE k = 1""",
        "merge_dedupe_first": _deduped("head"),
        "merge_dedupe_last": _deduped("last"),
        "merge_markdown": f"SELECT c.doc_id, coalesce(m.result, '') AS result FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) c LEFT JOIN (SELECT conv_id, string_agg(text, {_SEP} ORDER BY turn) AS result FROM conversations GROUP BY 1) m ON c.doc_id = m.conv_id",
        "merge_custom": "SELECT conv_id AS doc_id, first(text ORDER BY length(text) DESC, text DESC) AS result FROM conversations GROUP BY 1",
        "chain_markdown": f"""SELECT d.doc_id, coalesce(m.result, '') AS result FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN
  (SELECT doc_id, string_agg(split_part(w, {_NL}, 1) || '/' || length(w), {_SEP} ORDER BY k) AS result FROM (SELECT doc_id, k, substring(text, k * 800 + 1, 1000) AS w FROM ({_WINDOWS})) GROUP BY 1) m ON d.doc_id = m.doc_id""",
        "chain_orders": _packed(_ORDER_LINES, 300, len(_HEAD) + 1)
        + """, g AS (SELECT doc_id, c, arg_min(split_part(line, ' | ', 2), i) AS s, string_agg(split_part(line, ' ', 2), ',' ORDER BY i) AS keys FROM r GROUP BY 1, 2)
SELECT o.doc_id, coalesce(m.lines, '') AS lines FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders) o LEFT JOIN
  (SELECT doc_id, string_agg(keys, ',' ORDER BY c) AS lines FROM g WHERE s IN ('O', 'F') GROUP BY 1) m ON o.doc_id = m.doc_id""",
        "events": f"""WITH t AS (SELECT conv_id AS doc_id, string_agg(text, {_NL} ORDER BY turn) AS text FROM conversations GROUP BY 1),
c AS (SELECT doc_id, text, CASE WHEN length(text) <= 200 THEN 1 ELSE CAST(ceil((length(text) - 50) / 150.0) AS BIGINT) END AS n FROM t),
w AS (SELECT doc_id, n, k, substring(text, k * 150 + 1, 200) AS w FROM (SELECT *, unnest(range(n)) AS k FROM c)),
f AS (SELECT *, split_part(w, {_NL}, 1) || '/' || length(w) AS found FROM w)
SELECT doc_id, 0::BIGINT AS seq, 'normalizing' AS phase, false AS done, text AS content FROM t UNION ALL SELECT doc_id, 1 + k, 'chunking', false, w FROM w
UNION ALL SELECT doc_id, 1 + n + k, 'extracting', true, found FROM f UNION ALL SELECT doc_id, 1 + 2 * n, 'merging', true, string_agg(found, {_SEP} ORDER BY k) FROM f GROUP BY doc_id, n""",
    }
