"""DuckDB SQL of the fixtures, as common table expressions that the oracles start from."""

BOX = """
box AS (
  SELECT l_orderkey AS k, l_linenumber AS n, 'ABCU' || lpad((l_orderkey * 8 + l_linenumber)::VARCHAR, 7, '0') AS container,
    CASE WHEN l_linenumber % 2 = 0 THEN '20GP' ELSE '40HC' END AS ctype, sum(l_quantity)::BIGINT AS packs, min(l_suppkey) AS supp
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
BILL = (
    BOX
    + """, held AS (
  SELECT k, sum(packs)::BIGINT * 100 AS weight, min(supp) AS supp FROM box GROUP BY k
), bill AS (
  SELECT k, ['MAEU', 'MEDU', 'HLCU', 'ZIMU'][(k % 4 + 1)::INT] || lpad(k::VARCHAR, 9, '0') AS bl, s_name AS shipper, c_name AS consignee, a.n_name AS pol, b.n_name AS pod,
    weight, strftime(o_orderdate, '%d/%m/%Y') AS date
  FROM held JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON supp = s_suppkey
    JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
)"""
)
TEXT = (
    BILL
    + """, boxlines AS (
  SELECT k, string_agg('(CN) ' || container || ' ' || ctype || ' ' || packs || ' PKGS', chr(10) ORDER BY n) AS lines FROM box GROUP BY k
), page AS (
  SELECT k // 50 AS doc_id, (k % 50 // 10 + 1)::INT AS page_no, string_agg('B/L NO. ' || bl || chr(10) || 'SHIPPER ' || shipper || chr(10) || 'CONSIGNEE ' || consignee || chr(10)
    || 'PORT OF LOADING ' || pol || chr(10) || 'PORT OF DISCHARGE ' || pod || chr(10) || lines || chr(10) || 'WEIGHT ' || weight || ' KGS', chr(10) ORDER BY k) AS text
  FROM bill JOIN boxlines USING (k) GROUP BY 1, 2
)"""
)


def words(source: str, name: str = "word") -> str:
    """CTEs that turn a relation (doc_id, page_no, text) into words."""
    return f""", {name}_line AS (
  SELECT doc_id, page_no, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) - 1 AS line_no FROM {source}
), {name}_token AS (
  SELECT doc_id, page_no, line_no, unnest(regexp_extract_all(line, '\\s*\\S+')) AS token, generate_subscripts(regexp_extract_all(line, '\\s*\\S+'), 1) AS pos FROM {name}_line
), {name} AS (
  SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no, pos) - 1)::INT AS word_no, regexp_replace(token, '^\\s+', '') AS text,
    (e - length(regexp_replace(token, '^\\s+', ''))) * 6.0::DOUBLE AS x0, line_no * 12.0::DOUBLE AS top, e * 6.0::DOUBLE AS x1, line_no * 12.0::DOUBLE + 11 AS bottom
  FROM (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY pos) AS e FROM {name}_token)
)"""


WORDS = TEXT + words("page")
#: The words with tops moved apart, so that lines have to be found.
SHAKEN = WORDS + """, shaken AS (
  SELECT doc_id, page_no, word_no, text, x0, top + word_no % 3 AS top, x1, bottom + word_no % 3 AS bottom FROM word
)"""
LINES = SHAKEN + """, tops AS (
  SELECT doc_id, page_no, list_sort(list(DISTINCT top)) AS t FROM shaken GROUP BY ALL
), starts AS (
  SELECT doc_id, page_no, list_reduce(t[2:], lambda acc, x: CASE WHEN x - acc[-1] > 4.0 THEN list_append(acc, x) ELSE acc END, [t[1]]) AS s FROM tops
), line AS (
  SELECT shaken.*, len(list_filter(s, lambda y: y <= top)) - 1 AS line_no FROM shaken JOIN starts USING (doc_id, page_no)
)"""
RECORD = BILL + """, record AS (
  SELECT k // 50 AS doc_id, k % 50 * 8 + n AS row_no, CASE WHEN k % 17 <> 0 THEN bl END AS bl_number, CASE WHEN k % 11 <> 0 THEN 'MV DAWN' END AS vessel, container AS container_number, ctype AS container_type,
    'S' || n AS seal1, packs::VARCHAR AS pack_qty, CASE WHEN k % 13 = 0 THEN 'n/a' ELSE weight::VARCHAR END AS weight, printf('%.3f', packs / 4) AS volume, CASE WHEN k % 7 <> 0 THEN shipper END AS shipper, consignee,
    pol AS port_of_loading, CASE WHEN k % 19 <> 0 THEN pod END AS port_of_discharge, CASE k % 3 WHEN 0 THEN date WHEN 1 THEN 'soon' END AS date_of_arrival, CASE WHEN k % 2 = 0 THEN 'CY/CY' ELSE 'door' END AS movement,
    '' AS description, k % 5 = 0 AS user_edited
  FROM box JOIN bill USING (k)
)"""
