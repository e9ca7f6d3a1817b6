"""The layouts of packed fields and raw records in SQL, for the queries of problems 3 and 5."""

# A comma before a number with a decimal point is hidden while lists are split; a separator is put at the end of every field,
# so that each piece ends with one.
PACKED = r"""
WITH g AS (SELECT line_no, trim(dst, ' ' || chr(9)) AS s FROM input_graph WHERE dst IS NOT NULL),
g2 AS (SELECT line_no, CASE WHEN regexp_full_match(s, '"([^"]|"")*"|''([^'']|'''')*''') THEN trim(substr(s, 2, len(s) - 2), ' ' || chr(9)) ELSE s END AS s FROM g),
g3 AS (SELECT line_no, regexp_extract_all(regexp_replace(s, ',([0-9]+\.[0-9]*)', '~\1', 'g') || ';',
  '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^ \t,;|/]*)(?:[ \t]*[,;|/][ \t]*|[ \t]+)', 1) AS a FROM g2),
e AS (SELECT edge_id, regexp_extract_all(trim(value, ' ' || chr(9) || chr(10) || chr(13)) || ';',
  '( *"(?:[^"]|"")*" *| *''(?:[^'']|'''')*'' *|[^,;；|/\t\n]*)[,;；|/\t\n]', 1) AS a FROM edge_with_value WHERE value IS NOT NULL),
pieces AS (SELECT 'input_graph' AS ref_table, line_no AS row_id, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS p FROM g3
  UNION ALL SELECT 'edge_with_value', edge_id, unnest(generate_series(1, len(a))), unnest(a) FROM e),
vals AS (SELECT ref_table, row_id, pos, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS q FROM pieces),
clean AS (SELECT ref_table, row_id, CAST(pos AS INT) AS pos, CASE WHEN len(q) > 1 AND q[1] IN ('"', '''') AND q[-1] = q[1]
  THEN trim(replace(substr(q, 2, len(q) - 2), q[1] || q[1], q[1])) ELSE q END AS v FROM vals)
SELECT ref_table, row_id, pos, replace(v, '~', ',') AS val FROM clean WHERE v <> '' QUALIFY count(*) OVER (PARTITION BY ref_table, row_id) >= 2"""

_ID = "[0-9]+"
_NUMBER = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"

# j has line_id, feed, the fields v, the items of a list and the reason, null where the record is valid
JUDGED = rf"""
WITH r AS (SELECT line_id, feed, line_text AS t, CASE feed WHEN 'input_graph' THEN chr(9) ELSE ',' END AS sep FROM raw_lines
  WHERE line_text IS NOT NULL AND NOT regexp_matches(line_text, '^[#%]') AND regexp_matches(line_text, '\S') AND feed IN ('input_graph', 'edge_with_value')),
q AS (SELECT *, CASE feed WHEN 'input_graph' THEN regexp_full_match(t, '( *("([^"]|"")*" *|[^"\t]*))(\t *("([^"]|"")*" *|[^"\t]*))*', 's')
  ELSE regexp_full_match(t, '([ \t]*("([^"]|"")*"[ \t]*|[^",]*))(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*', 's') END AS quoted FROM r),
c AS (SELECT *, CASE feed WHEN 'input_graph' THEN regexp_extract_all(t || sep, '( *"(?:[^"]|"")*" *|[^"\t]*)\t', 1, 's')
  ELSE regexp_extract_all(t || sep, '([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*),', 1, 's') END AS raw FROM q),
f AS (SELECT *, list_transform(raw, lambda x: trim(x, CASE feed WHEN 'input_graph' THEN ' ' ELSE ' ' || chr(9) END)) AS x FROM c),
u AS (SELECT *, list_transform(x, lambda y: CASE WHEN len(y) > 1 AND y[1] = '"' THEN replace(substr(y, 2, len(y) - 2), '""', '"') ELSE y END) AS v FROM f),
l AS (SELECT *, list_filter(regexp_split_to_array(coalesce(v[2], ''), '[ \t]+'), lambda y: y <> '') AS items FROM u),
j AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> CASE feed WHEN 'input_graph' THEN 2 ELSE 4 END THEN 'columns'
  WHEN NOT regexp_full_match(v[1], '{_ID}') OR try_cast(v[1] AS UINTEGER) IS NULL THEN 'src'
  WHEN feed = 'input_graph' AND (len(items) = 0 OR NOT regexp_full_match(items[1], '{_ID}') OR coalesce(try_cast(items[1] AS BIGINT), -1) <> len(items) - 1) THEN 'edge_count'
  WHEN feed = 'input_graph' AND len(list_filter(items[2:], lambda y: NOT regexp_full_match(y, '{_ID}(,{_NUMBER})?') OR try_cast(split_part(y, ',', 1) AS UINTEGER) IS NULL)) > 0 THEN 'dst'
  WHEN feed = 'edge_with_value' AND (NOT regexp_full_match(v[2], '{_ID}') OR try_cast(v[2] AS UINTEGER) IS NULL) THEN 'dst'
  WHEN feed = 'edge_with_value' AND v[3] <> '' AND NOT regexp_full_match(v[3], '{_NUMBER}') THEN 'value' END AS reason FROM l)
"""

ORACLES = {
    "p3_found": PACKED,
    "p5_found": JUDGED + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_report": JUDGED + "SELECT feed, reason, count(*) AS n_lines FROM j WHERE reason IS NOT NULL GROUP BY feed, reason",
    "p5_loaded_edges": JUDGED
    + """SELECT line_id, CAST(v[1] AS BIGINT) AS src, CAST(v[2] AS BIGINT) AS dst, CAST(nullif(v[3], '') AS DOUBLE) AS value, nullif(v[4], '') AS note
FROM j WHERE reason IS NULL AND feed = 'edge_with_value'""",
    "p5_loaded_graph": JUDGED
    + """, n AS (SELECT line_id, CAST(v[1] AS BIGINT) AS src, CAST(items[1] AS BIGINT) AS edge_count, unnest(CASE WHEN len(items) > 1 THEN items[2:] ELSE [NULL] END) AS y
FROM j WHERE reason IS NULL AND feed = 'input_graph')
SELECT line_id, src, edge_count, CAST(split_part(y, ',', 1) AS BIGINT) AS dst, CASE WHEN contains(y, ',') THEN CAST(split_part(y, ',', 2) AS DOUBLE) END AS weight FROM n""",
}
