"""SQL of the queries that SQL can express."""

_STRIP = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))"


def _canon(c: str) -> str:
    """Canonical text of a url: stripped base, then the sorted stripped parameters; NULL and 'null' alike."""
    v = f"nullif({c}, 'null')"
    base = f"CASE WHEN instr({v}, '?') > 0 THEN substr({v}, 1, instr({v}, '?') - 1) ELSE {v} END"
    query = f"CASE WHEN instr({v}, '?') > 0 THEN substr({v}, instr({v}, '?') + 1) ELSE '' END"
    params = f"list_sort(list_filter(list_transform(string_split({query}, '&'), lambda x: {_STRIP.format('x')}), lambda x: x <> ''))"
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE list_prepend({_STRIP.format(base)}, {params}) END"


_SIZE = "regexp_full_match(filesize, '[1-9][0-9]{0,8}') AND TRY_CAST(filesize AS BIGINT) <= 536870912"

_T = "(coalesce(logged_at, TIMESTAMP '0001-01-01'), record_id)"
_REST = ("sourceurl", "pageurl", "docordataseturl", "wasurlchecked", "wasurlvalid", "wasdirectlink", "filehash", "mimetype", "filepath", "error")
_FORMS = {"filehash": "regexp_full_match(filehash, '[0-9a-f]{32}')", "mimetype": "(mimetype = 'unspecified' OR regexp_full_match(mimetype, '[a-z0-9.+-]+/[a-z0-9.+-]+')) AND length(mimetype) <= 255", "docordataseturl": "docordataseturl LIKE 'http%'"}
_PICKS = ", ".join(f"arg_max({c}, {_T}) FILTER ({c} IS NOT NULL AND {c} <> 'null' AND {_FORMS.get(c, 'true')}) AS {c}" for c in _REST)

SQL = {
    "p5_survivors": f"""
SELECT id, count(*) AS n_records,
  nullif(coalesce(arg_max(wasdocumentordatasetaccessible, {_T}) FILTER (wasdocumentordatasetaccessible = 'true'), arg_max(wasdocumentordatasetaccessible, {_T}) FILTER (wasdocumentordatasetaccessible = 'false'),
    arg_max_null(wasdocumentordatasetaccessible, {_T})), 'null') AS wasdocumentordatasetaccessible,
  arg_max(filesize, {_T}) FILTER ({_SIZE}) AS filesize, arg_max(couldretry, {_T}) FILTER (couldretry IN ('true', 'false')) AS couldretry, {_PICKS}
FROM output_record WHERE id IS NOT NULL AND id NOT IN ('null', 'unretrievable') GROUP BY id""",
    "p3_found": """
WITH k AS (
  SELECT record_id, 'docordataseturl' AS field_name, docordataseturl AS v FROM output_record WHERE docordataseturl LIKE 'http%'
  UNION ALL SELECT record_id, 'filehash', filehash FROM output_record WHERE regexp_full_match(filehash, '[0-9a-f]{32}')),
e AS (SELECT DISTINCT CASE key_kind WHEN 'url' THEN 'docordataseturl' WHEN 'hash' THEN 'filehash' END AS field_name, key_value AS v FROM earlier_key),
r AS (SELECT k.*, min(record_id) OVER (PARTITION BY field_name, v) AS first_id FROM k)
SELECT record_id, field_name FROM r LEFT JOIN e USING (field_name, v) WHERE record_id > first_id OR e.v IS NOT NULL""",
    "p4_found": f"""
WITH o AS (SELECT record_id AS k, min(record_id) OVER (PARTITION BY id, {_canon('sourceurl')}, {_canon('pageurl')}) AS f FROM output_record),
s AS (SELECT seq AS k, min(seq) OVER (PARTITION BY id, {_canon('url')}) AS f FROM sample_input)
SELECT 'output_record' AS table_name, f AS first_key, k AS copy_key FROM o WHERE k <> f
UNION ALL SELECT 'sample_input', f, k FROM s WHERE k <> f""",
    "p4_collapsed": f"""
SELECT 'output_record' AS table_name, min(record_id) AS first_key, count(*) AS n_copies FROM output_record GROUP BY id, {_canon('sourceurl')}, {_canon('pageurl')}
UNION ALL SELECT 'sample_input', min(seq), count(*) FROM sample_input GROUP BY id, {_canon('url')}""",
    "p5_found": f"""
WITH r AS (SELECT *, CASE wasdocumentordatasetaccessible WHEN 'true' THEN 2 WHEN 'false' THEN 1 ELSE 0 END AS acc, ({_SIZE}) AS sized, couldretry IN ('true', 'false') AS known
  FROM output_record WHERE id IS NOT NULL AND id NOT IN ('null', 'unretrievable')),
w AS (SELECT id, record_id, acc, sized, known, count(*) OVER (PARTITION BY id) AS n,
  row_number() OVER (PARTITION BY id ORDER BY acc DESC, logged_at DESC NULLS LAST, record_id DESC) AS ra,
  row_number() OVER (PARTITION BY id, coalesce(sized, false) ORDER BY logged_at DESC NULLS LAST, record_id DESC) AS rs,
  row_number() OVER (PARTITION BY id, coalesce(known, false) ORDER BY logged_at DESC NULLS LAST, record_id DESC) AS rk FROM r)
SELECT id, max(CASE WHEN ra = 1 THEN record_id END) AS accessible_record_id,
  coalesce(max(CASE WHEN sized AND rs = 1 THEN record_id END), 0) AS filesize_record_id,
  coalesce(max(CASE WHEN known AND rk = 1 THEN record_id END), 0) AS couldretry_record_id
FROM w WHERE n >= 2 GROUP BY id""",
}
